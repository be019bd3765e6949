"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into paragraphs: lines, their sentences, and runs of ``RUN`` words of long
sentences.  Each paragraph's digest (with the number of its earlier occurrences, so
repeats count) is added to three cells; a cell holds a count, and sums of digests, of check
values and of the paragraphs' lengths.  Cells of two versions subtract; where one differing
digest is alone in a cell it can be read off with its length and taken out of its other
cells, until all are recovered.  If some remain, both versions are sketched anew with twice
the cells; with more cells than their paragraphs could need, the digests are compared one
by one.  The likeness of two texts is the part of their bytes that lies in no differing
paragraph.

All documents of a slice are sketched and peeled together in array passes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import SpanHash, buffer_of, chunks, mix, seeded, shuffle_partitions, spans, table, text_or_empty

CELLS = 24
HASHES = 3
RUN = 8
#: Cells for each paragraph beyond which a sketch is not tried again.
MOST_CELLS = 8
_CELL = np.dtype([("count", "<i4"), ("sum", "<u8"), ("check", "<u4"), ("size", "<i8")])


@dataclass
class Paragraphs:
    """Digests and lengths in bytes of many texts' paragraphs; ``row`` tells the text."""

    n: int
    row: np.ndarray
    key: np.ndarray
    size: np.ndarray

    def of(self, wanted: np.ndarray) -> Paragraphs:
        """Those of the wanted texts, numbered in their order."""
        place = np.full(self.n, -1)
        place[wanted] = np.arange(len(wanted))
        row = place[self.row]
        return Paragraphs(len(wanted), row[row >= 0], self.key[row >= 0], self.size[row >= 0])

    def weights(self) -> np.ndarray:
        return np.bincount(self.row, self.size.astype(float), self.n)


def paragraphs(texts: list[str]) -> Paragraphs:
    data, offsets = buffer_of(pa.array(texts, pa.large_string()))
    size = len(data)
    if not size:
        return Paragraphs(len(texts), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    after_line = np.flatnonzero(data[:-1] == 10) + 1
    ends = np.flatnonzero(np.isin(data[:-2], list(b".!?")) & (data[1:-1] == 32)) + 2 if size > 2 else after_line[:0]
    cut = np.zeros(size, bool)
    cut[after_line] = True
    cut[ends] = True
    cut[offsets[offsets < size]] = True
    words, _ = spans((data != 32) & ((data < 9) | (data > 13)), offsets)
    sentence = np.cumsum(cut)[words]
    first = np.searchsorted(sentence, sentence)  # each word's first word of its sentence
    cut[words[(np.arange(len(words)) - first) % RUN == 0]] = True
    # A sentence's white space before its first word stays with it.
    starts = np.flatnonzero(cut)
    stops = np.append(starts[1:], size)
    row = np.searchsorted(offsets, starts, "right") - 1
    raw = SpanHash(data)(starts, stops)
    order = np.lexsort((raw, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (raw[order][1:] != raw[order][:-1])
    began = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    earlier = np.empty(len(order), np.uint64)
    earlier[order] = np.arange(len(order)) - began
    key = mix(raw + earlier * np.uint64(0x9E3779B97F4A7C15))
    return Paragraphs(len(texts), row, key, stops - starts)


def _places(key: np.ndarray, cells: int) -> list[np.ndarray]:
    part = cells // HASHES
    salts = seeded(HASHES, cells)
    return [(mix(key ^ s) % np.uint64(part)).astype(np.int64) + j * part for j, s in enumerate(salts)]


def _check(key: np.ndarray) -> np.ndarray:
    return mix(key + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)


@dataclass
class Sketch:
    """Cells of many texts, a row each."""

    count: np.ndarray
    total: np.ndarray
    check: np.ndarray
    size: np.ndarray

    @property
    def sums(self) -> tuple[np.ndarray, ...]:
        return self.count, self.total, self.check, self.size

    @classmethod
    def of(cls, items: Paragraphs, cells: int) -> Sketch:
        out = cls(*(np.zeros(items.n * cells, t) for t in (np.int64, np.uint64, np.uint64, np.int64)))
        out._add(items.row, items.key, items.size, np.ones(len(items.key), np.int64), cells)
        return cls(*(x.reshape(items.n, cells) for x in out.sums))

    def _add(self, row: np.ndarray, key: np.ndarray, size: np.ndarray, sign: np.ndarray, cells: int) -> None:
        factor = sign.astype(np.uint64)  # -1 wraps, as the sums do
        for place in _places(key, cells):
            at = row * cells + place
            np.add.at(self.count, at, sign)
            np.add.at(self.total, at, key * factor)
            np.add.at(self.check, at, _check(key) * factor)
            np.add.at(self.size, at, size * sign)

    def __sub__(self, other: Sketch) -> Sketch:
        return Sketch(*(a - b for a, b in zip(self.sums, other.sums, strict=True)))

    def take(self, rows: slice) -> Sketch:
        return Sketch(*(x[rows] for x in self.sums))

    def text(self) -> list[str]:
        cells = np.zeros(self.count.shape, _CELL)
        cells["count"], cells["sum"], cells["check"] = self.count, self.total, self.check & np.uint64(0xFFFFFFFF)
        cells["size"] = self.size
        return [base64.b64encode(c.tobytes()).decode() for c in cells]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a difference: row, digest, length and side (1 or -1) of what was recovered, and
        the rows of which nothing is left."""
        n, cells = self.count.shape
        rest = Sketch(*(x.copy().ravel() for x in self.sums))
        found: list[tuple[np.ndarray, ...]] = []
        while True:
            at = np.flatnonzero(np.abs(rest.count) == 1)
            sign = rest.count[at]
            key = rest.total[at] * sign.astype(np.uint64)
            pure = rest.check[at] == _check(key) * sign.astype(np.uint64)
            row, key, sign, size = at[pure] // cells, key[pure], sign[pure], (rest.size[at] * sign)[pure]
            if not len(row):
                break
            order = np.lexsort((key, row))
            row, key, sign, size = row[order], key[order], sign[order], size[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, sign, size = row[new], key[new], sign[new], size[new]
            found.append((row, key, size, sign))
            rest._add(row, key, size, -sign, cells)
            if len(found) > 4 * cells:  # a false reading could go round for ever
                break
        left = (rest.count != 0) | (rest.total != 0) | (rest.check != 0) | (rest.size != 0)
        kinds = (np.int64, np.uint64, np.int64, np.int64)
        parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate(kinds)]
        return *parts, ~left.reshape(n, cells).any(axis=1)


def difference_weights(a: Paragraphs, b: Paragraphs, sketched: Sketch | None = None) -> np.ndarray:
    """For each pair of texts, the bytes in recovered differing paragraphs."""
    out, todo, cells = np.zeros(a.n), np.arange(a.n), CELLS
    while len(todo):
        if sketched is None:
            x, y = a.of(todo), b.of(todo)
            most = np.bincount(np.concatenate((x.row, y.row)), minlength=len(todo)).max()
            if cells > MOST_CELLS * most + CELLS:  # two digests of a text are one: no sketch tells them apart
                out[todo] = _differing(x, y)
                break
            sketched = Sketch.of(x, cells) - Sketch.of(y, cells)
        row, _, size, _, done = sketched.peel()
        got = np.bincount(row, size.astype(float), len(todo))
        out[todo[done]] = got[done]
        todo, cells, sketched = todo[~done], 2 * cells, None
    return out


def _differing(a: Paragraphs, b: Paragraphs) -> np.ndarray:
    """The bytes in paragraphs that only one of two texts has, by comparing digests."""
    row, key = np.concatenate((a.row, b.row)), np.concatenate((a.key, b.key))
    size, side = np.concatenate((a.size, b.size)), np.repeat([1, -1], [len(a.row), len(b.row)])
    order = np.lexsort((key, row))
    first = np.ones(len(order), bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
    group = np.cumsum(first) - 1
    balance = np.abs(np.bincount(group, side[order], int(first.sum())))
    return np.bincount(row[order][first], balance * size[order][first], a.n)


def likeness(a: Paragraphs, b: Paragraphs, sketched: Sketch | None = None) -> np.ndarray:
    both = a.weights() + b.weights()
    return np.where(both > 0, 1 - difference_weights(a, b, sketched) / np.maximum(both, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    """The last quarter replaced by as many code points of the start of another text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _fingerprints(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """Rows for all but the last text, which only follows."""
    edited = [edited_text(t, f) for t, f in zip(texts, texts[1:], strict=False)]
    n = len(edited)
    all_own, own_edited = paragraphs(texts), paragraphs(edited)
    own, following = all_own.of(np.arange(n)), all_own.of(np.arange(1, n + 1))
    sketch, sketch_edited = Sketch.of(all_own, CELLS), Sketch.of(own_edited, CELLS)
    first, second = sketch.take(slice(0, n)), sketch.take(slice(1, n + 1))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(first.text()),
        pa.array(sketch_edited.text()),
        pa.array(likeness(own, own_edited, first - sketch_edited)),
        pa.array(likeness(own, following, first - second)),
    ], schema=SCHEMA)


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next for every row.

    The next document is that with the next larger doc_id; rows with equal doc_id follow
    each other in the order of their texts, null ids come first, and the last row is
    followed by the first.  A null text is empty; its cells are zero, and two empty
    texts are alike (1.0).  Other columns are ignored.  No rows: no result.

    Documents are dealt into ranges of doc_id; the first document of a range is also sent
    to the range before it.
    """
    spark = docs.sparkSession
    lowest = -(2**63)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("place"),
        text_or_empty().alias("text"),
    )
    n = shuffle_partitions(spark)
    quantiles = rows.agg(F.percentile_approx("place", F.lit([i / n for i in range(n)]), 10_000).alias("q"), F.min("place").alias("least")).first()
    heads = np.unique(np.array([quantiles["least"] if quantiles["least"] is not None else 0, *(quantiles["q"] or ())], np.int64))

    @F.arrow_udf("int")
    def range_of(place: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(heads, place.to_numpy(zero_copy_only=False), "right") - 1, pa.int32())

    rows = rows.withColumn("part", range_of(F.col("place"))).withColumn("copy", F.lit(False))
    last = F.lit(len(heads) - 1)
    copies = rows.where(F.col("place").isin([int(h) for h in heads]))
    copies = copies.withColumn("part", F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1)).withColumn(
        "copy", F.lit(True)
    )
    dealt = rows.unionByName(copies).repartitionById(len(heads), F.col("part")).sortWithinPartitions("copy", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        ended = False
        for batch in chunks(batches):
            new_ids, new_texts, copy = (batch.column(i).to_pylist() for i in range(3))
            if True in copy:
                end = copy.index(True) + (not ended)  # the first copy is what follows
                new_ids, new_texts, ended = new_ids[:end], new_texts[:end], True
            ids, texts = ids + new_ids, texts + new_texts
            if len(texts) > 1:
                yield _fingerprints(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]

    return dealt.select("doc_id", "text", "copy").mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))
