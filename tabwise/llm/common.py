"""Helpers shared by the training-data operators: tables, shared storage, text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one round of array work handles; bounds the memory of a task.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == pa.string() else np.int64)
        offsets = offsets[column.offset : column.offset + len(column) + 1]
        start = 0
        while start < len(column):
            end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            end = min(max(end, start + 1), len(column))
            yield batch.slice(start, end - start)
            start = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and each row's start in them."""
    kind = np.int32 if column.type == pa.string() else np.int64
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * np.uint64(0x9E3779B97F4A7C15))


#: Parts of a 64-bit hash that each set a bit, by the bits below them.
PROBES = (0, 19, 37)


def bitmap_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap (``bits`` is a power of two up to 2**27) with ``PROBES`` bits for each 64-bit
    hash, the only column; the driver gets its set words, whose number ``bits`` bounds."""
    hash_ = F.col(hashes.columns[0])
    slots = F.array(*[F.shiftrightunsigned(hash_, n).bitwiseAND(F.lit(bits - 1)) for n in PROBES])
    words = hashes.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("set")
    ).toArrow()
    full = np.zeros(bits // 64, "<i8")
    full[words["word"].to_numpy()] = words["set"].to_numpy()
    return full.view(np.uint8)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in it; of others, those whose bits all happen to be set."""
    found = np.ones(len(hashes), bool)
    for n in PROBES:
        slot = (hashes >> np.uint64(n)) & np.uint64(8 * len(bitmap) - 1)
        found &= (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


class SpanHash:
    """64-bit hashes of any spans of a byte buffer, from one running sum.

    Byte ``b`` at place ``i`` adds ``value[b] * base**i`` (mod 2**64); a span's
    difference of running sums, times ``base**-start``, does not depend on where it lies.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    VALUES = seeded(256, 7)
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n:
            size = max(n, 2 * CHUNK_BYTES)
            for name, base in (("_up", cls.BASE), ("_down", pow(cls.BASE, -1, 1 << 64))):
                factors = np.full(size, np.uint64(base))
                factors[0] = 1
                setattr(cls, name, np.multiply.accumulate(factors))
        return cls._up, cls._down

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = self._powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that stay within one row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = True
    last[cuts - 1] = True
    return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
