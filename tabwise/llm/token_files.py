"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents as blocks of ``BLOCK`` ids.  A block
stores its least id and the differences to it at the width that ``PERCENTILE`` of them
need; the few that need more are cut to that width and stored in full in the block's
exception list.  An index of block starts makes any id reachable with one seek.

Layout, little-endian::

    "TPFR" version:u32
    block*        base:u32  width:u8  n_exceptions:u16  packed bits
                  exception places:u16*  exception differences:u32*
    block starts  u64*
    documents     doc_id:i64*  null flags:u8*  first id:u64*
    footer        n_ids, n_blocks, n_docs, place of the block starts: u64, "TPFR"
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabwise.functions.staging import stage
from tabwise.llm import storage
from tabwise.llm.common import chunks, shuffle_partitions, table, text_or_empty
from tabwise.llm.tokens import Encoder, vocabulary

MAGIC = b"TPFR"
VERSION = 1
BLOCK = 1024
PERCENTILE = 90
#: Blocks packed or unpacked at once.
BATCH_BLOCKS = 256
FOOTER = struct.Struct("<QQQQ4s")
HEAD = struct.Struct("<IBH")


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits needed by each value below 2**32."""
    return np.frexp(x.astype(np.float64))[1]


def pack(values: np.ndarray, width: int) -> bytes:
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # 8 bytes from each byte on
    at = np.arange(n, dtype=np.int64) * width
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def encode_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    base = int(ids.min())
    rest = ids - np.uint32(base)
    lengths = bit_length(rest)
    rank = max(0, -(-len(ids) * percentile // 100) - 1)
    width = int(np.partition(lengths, rank)[rank])
    over = np.flatnonzero(lengths > width)
    packed = pack(rest & np.uint32((1 << width) - 1), width) if width else b""
    return b"".join((
        HEAD.pack(base, width, len(over)), packed, over.astype("<u2").tobytes(), rest[over].astype("<u4").tobytes()
    ))


def decode_block(data: bytes, n: int) -> np.ndarray:
    base, width, n_over = HEAD.unpack_from(data)
    size = (n * width + 7) // 8
    out = unpack(data[HEAD.size : HEAD.size + size], n, width)
    at = HEAD.size + size
    if n_over:
        out[np.frombuffer(data, "<u2", n_over, at)] = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
    return out + np.uint32(base)


class Writer:
    """Appends documents to one file."""

    def __init__(self, stream) -> None:
        self.stream = stream
        self.place = stream.write(MAGIC + struct.pack("<I", VERSION)) or 8
        self.pending, self.waiting = [], 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, bool, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.n_ids))
        self.n_ids += len(ids) // 4
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * BLOCK * BATCH_BLOCKS:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        out, place = [], self.place
        for i in range(0, n, BLOCK):
            out.append(block := encode_block(ids[i : min(i + BLOCK, n)]))
            self.starts.append(place)
            place += len(block)
        self.stream.write(b"".join(out))
        self.place = place
        self.pending, self.waiting = [ids[n:].tobytes()], 4 * (len(ids) - n)

    def close(self) -> None:
        self._flush(last=True)
        self.stream.write(np.array(self.starts, "<u8").tobytes())
        doc_ids, nulls, firsts = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        self.stream.write(np.array(doc_ids, "<i8").tobytes())
        self.stream.write(np.array(nulls, np.uint8).tobytes())
        self.stream.write(np.array(firsts, "<u8").tobytes())
        self.stream.write(FOOTER.pack(self.n_ids, len(self.starts), len(self.docs), self.place, MAGIC))
        self.stream.close()


class Reader:
    """Reads documents, or any run of ids, from one file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        self.n_ids, self.n_blocks, n_docs, at, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        index = self._bytes(at, size - FOOTER.size - at)
        self.starts = np.append(np.frombuffer(index, "<u8", self.n_blocks), np.uint64(at)).astype(np.int64)
        at = 8 * self.n_blocks
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, at)
        self.nulls = np.frombuffer(index, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        self.firsts = np.append(np.frombuffer(index, "<u8", n_docs, at + 9 * n_docs), np.uint64(self.n_ids)).astype(np.int64)

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        data, base = self._bytes(self.starts[first], self.starts[last] - self.starts[first]), self.starts[first]
        blocks = [
            decode_block(data[self.starts[b] - base : self.starts[b + 1] - base], min(BLOCK, self.n_ids - b * BLOCK))
            for b in range(first, last)
        ]
        return np.concatenate(blocks)[start - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's place, ids), a few blocks' worth of documents at a time."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.firsts, self.firsts[i] + BLOCK * BATCH_BLOCKS, "right")) - 1)
            ids, base = self.ids(self.firsts[i], self.firsts[j]), self.firsts[i]
            for k in range(i, j):
                yield (
                    None if self.nulls[k] else int(self.doc_ids[k]),
                    int(self.firsts[k]),
                    ids[self.firsts[k] - base : self.firsts[k + 1] - base],
                )
            i = j


def write_token_files(docs: DataFrame, vocabulary_path: str, end_id: int, *, files: int | None = None) -> DataFrame:
    """Writes every document's ids and ``end_id``, in ascending doc_id order.

    Returns the manifest: part, path, n_docs, n_ids, one row per file; the files' order
    is that of ``part``.  A null text is empty and holds the end id alone; a null doc_id
    comes first and is kept as null; rows that repeat a doc_id are ordered by a hash of
    their text, then by the text, and all kept.  Other columns are ignored.  No rows: no files.
    """
    spark = docs.sparkSession
    folder = storage.new_folder(spark, "token-files")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = writer = uri = None
        for batch in chunks(batches):
            if writer is None:
                encode = Encoder(vocabulary_path)
                uri, stream = storage.create_file(folder, ".tpfr")
                writer = Writer(stream)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [uri],
                "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64()),
            })

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .repartitionByRange(files or shuffle_partitions(spark), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    return stage(rows.mapInArrow(write, "part int, path string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                for doc_id, first, ids in Reader(storage.open_file(path)).documents():
                    out.append((doc_id, base + first, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )

    return placed.repartition(shuffle_partitions(spark), "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)
    return read_token_files(manifest)
