"""Benchmark decontamination by random-walk embedding and bit sampling.

The CGK embedding reads a word sequence by a random walk that goes on or stays at each
step depending on the word read; sequences within a small edit distance then agree in
most steps, so edit distance becomes Hamming distance.  Items longer than ``SEGMENT`` words
are cut into equal segments, one of which holds at most its share of the edits.  Several
embeddings are taken of every segment and of every window of a document's words as long as
one, and each is sampled several times at a few steps; windows that agree with a segment in
all steps of a sample are candidates.  The edit distance itself, over the whole item,
confirms them.  Items too short for an edit are looked up by their whole run of words.

Items are reduced to their different texts, and stay tables: tasks over the documents get
two bitmaps of fixed size, of the items' words and of their samples' keys, which pass
windows on.  Only these meet the items, in joins by key; what a bit lets pass by chance
ends there.  Windows with more words foreign to all segments of their length than a
segment's share of edits are passed over before; none of them can match.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.staging import stage
from tabwise.llm.common import SpanHash, bitmap_of, buffer_of, chunks, in_bitmap, mix, seeded, spans, table, text_or_empty

#: Share of an item's words that may be edited: one in so many.
EDIT_EVERY = 5
#: Recall at the full edit limit is 0.95 or more with these (see the test).
EMBEDDINGS, SAMPLINGS, STEPS = 8, 8, 5
#: Words of the longest segment.
SEGMENT = 32
#: A class of segments has lengths below this times its least.
CLASS_RATIO = 1.25
#: Steps of a walk by words of the window: after 1.6 a walk has read four fifths.
WALK = 1.6
#: Parts over which the documents that share an item's key are dealt.
SALTS = 16
#: Bits of the bitmaps for each entry, and of the largest (16 MB).
WORD_BITS, KEY_BITS, MOST_BITS = 64, 256, 1 << 27
SEED = 11

_B = np.arange(256)
_WORD = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)


@dataclass
class Words:
    """The words of many texts: symbols, their bytes, and each text's first word."""

    symbols: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Runs of letters and digits; A-Z and their Latin-1 accented kin lower-cased."""
    data, offsets = buffer_of(texts)
    low = _LOWER[data]
    if len(low) > 1:
        accented = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][accented] += 0x20
    starts, ends = spans(_WORD[data], offsets)
    return Words(SpanHash(low)(starts, ends), starts, ends, np.searchsorted(starts, offsets))


def edit_distance_within(masks: dict[int, int], n: int, text: Sequence[int]) -> tuple[int, int]:
    """The least edit distance of a pattern of ``n`` symbols to a run of ``text``, and the
    end of the first such run (bit-parallel; ``masks`` has the pattern's places by symbol)."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for i, symbol in enumerate(text):
        eq = masks.get(symbol, 0)
        x = eq | down
        d = ((((x & up) + up) & full) ^ up) | x
        h_up, h_down = down | (~(d | up) & full), up & d
        score += 1 if h_up & top else -1 if h_down & top else 0
        h_up, h_down = (h_up << 1) & full, (h_down << 1) & full
        up, down = h_down | (~(d | h_up) & full), h_up & d
        if score < best:
            best, end = score, i + 1
    return best, end


def run_start(pattern: Sequence[int], text: Sequence[int]) -> int:
    """Where the run ends that starts at the end of ``text`` and has the least distance:
    both are read backwards, and of equal distances the longest run counts."""
    pattern, text = pattern[::-1], text[::-1]
    row = list(range(len(text) + 1))
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return max(j for j, d in enumerate(row) if d == min(row))


def edits_of(n: int) -> int:
    """Word edits that an item of ``n`` words may show."""
    return n // EDIT_EVERY


def _ladder() -> list[int]:
    sizes = [1]
    while sizes[-1] <= SEGMENT:
        sizes.append(max(sizes[-1] + 1, int(sizes[-1] * CLASS_RATIO)))
    return sizes


#: The classes' window lengths, and one that none reaches.
SIZES = _ladder()


def class_of(n: int) -> int:
    """The window length for a segment of ``n`` words: the largest that it fills."""
    return max(s for s in SIZES if s <= n)


def class_edits(size: int) -> int:
    """The most edits that the least edited segment of an item can have in a class."""
    return -(-SIZES[SIZES.index(size) + 1] // EDIT_EVERY) - 1


def segments_of(n: int) -> list[int]:
    """Where the segments of an item of ``n`` words start, and the end."""
    parts = -(-n // SEGMENT)
    return [n * k // parts for k in range(parts + 1)]


def _named(keys: np.ndarray, size: int, sample: int) -> np.ndarray:
    return mix(keys ^ seeded(1, 1000 * size + sample + 7))


def window_keys(symbols: np.ndarray, at: np.ndarray, end: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``at``, keys) for each sample of the windows from ``at`` to ``end``.

    A window has no key for a sample that reads beyond its end.
    """
    everywhere = np.arange(len(at))
    if not class_edits(size):
        whole = at + size <= end
        keys = np.zeros(int(whole.sum()), np.uint64)
        for k in range(size):
            keys = mix(keys * np.uint64(3) + symbols[at[whole] + k])
        yield everywhere[whole], _named(keys, size, 0)
        return
    draw = np.random.default_rng(SEED + size)
    # Different steps each: the same one twice would tell less.
    order = draw.random((EMBEDDINGS, SAMPLINGS, int(WALK * size))).argsort(axis=2)
    samples = np.sort(order[:, :, :STEPS], axis=2)
    padded = np.append(symbols, np.uint64(0))
    for embedding, rows in enumerate(samples):
        keys, inside_all = np.zeros((SAMPLINGS, len(at)), np.uint64), np.ones((SAMPLINGS, len(at)), bool)
        wanted: dict[int, list[int]] = defaultdict(list)
        for s, row in enumerate(rows.tolist()):
            for j in row:
                wanted[j].append(s)
        where, salts = at.copy(), seeded(int(rows.max()) // 64 + 1, 100 + embedding)
        choice = padded
        for j in range(int(rows.max()) + 1):
            if j % 64 == 0:
                choice = mix(padded ^ salts[j // 64])
            inside = where < end
            place = np.where(inside, where, len(symbols))
            for s in wanted.get(j, ()):
                keys[s] = mix(keys[s] * np.uint64(3) + padded[place] + np.uint64(j))
                inside_all[s] &= inside
            where += (choice[place] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
        for s in range(SAMPLINGS):
            kept = inside_all[s]
            yield everywhere[kept], _named(keys[s][kept], size, embedding * SAMPLINGS + s)


# --- items --------------------------------------------------------------------


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, uid (digest of the words), symbols, n: the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = words_of(batch.column(1))
            symbols = [words.symbols[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            uids = [hashlib.md5(x).hexdigest() for x in symbols]
            sizes = [len(x) // 8 for x in symbols]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(uids), pa.array(symbols, pa.binary()), pa.array(sizes, pa.int32())], ["item_id", "uid", "symbols", "n"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    return items.mapInArrow(run, "item_id long, uid string, symbols binary, n int").where("n > 0")


def item_keys(items: DataFrame) -> DataFrame:
    """uid, n, offset (of the segment), size (its class), key, and word: a row for each
    key of each segment, and one for each of its words."""
    names = ["uid", "n", "offset", "size", "key", "word"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                symbols = np.frombuffer(data, np.uint64)
                cuts, n, rows = segments_of(len(symbols)), len(symbols), []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    size = class_of(b - a)
                    for _, key in window_keys(symbols, np.array([a]), np.array([a + size]), size):
                        rows += [(uid, n, a, size, k, None) for k in key.view(np.int64).tolist()]
                for size in {class_of(b - a) for a, b in zip(cuts, cuts[1:], strict=False)}:
                    known = np.unique(word_hashes(symbols, size))
                    rows += [(uid, n, None, size, None, w) for w in known.view(np.int64).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return items.select("uid", "symbols").mapInArrow(run, "uid string, n int, offset int, size int, key long, word long")


def word_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Words as members of a class."""
    return mix(symbols ^ seeded(1, 5000 + size))


# --- documents ----------------------------------------------------------------

SUSPECT = "row long, doc long, doc_id long, digest string, symbols binary, starts binary, ends binary, keys array<long>, places array<long>"


def suspects(docs: DataFrame, reach: dict[int, int], known, keys) -> DataFrame:
    """The parts of documents around windows whose key may be an item's: their words, and
    the windows by key and place in the part.

    ``reach`` has for each class of windows how many words to either side an item may be.
    """
    sizes = sorted(reach)

    def hits(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, key and reach of the windows."""
        symbols, n = words.symbols, len(words.symbols)
        stop = np.repeat(words.first[1:], np.diff(words.first))
        sums, found = np.zeros(n + 1, np.int64), []
        for size in sizes:
            np.cumsum(in_bitmap(known.value, word_hashes(symbols, size)), out=sums[1:])
            end = np.minimum(np.arange(n) + size, stop)
            at = np.flatnonzero(sums[end] - sums[:-1] >= size - class_edits(size))
            if len(at):
                read, first, last = symbols, at, end[at]
                if len(at) * size < n:  # only what the few windows hold
                    first = np.arange(len(at)) * size
                    read = symbols[np.minimum(at[:, None] + np.arange(size), n - 1)].ravel()
                    last = first + end[at] - at
                for places, key in window_keys(read, first, last, size):
                    hit = in_bitmap(keys.value, key)
                    found.append((at[places[hit]], key[hit], np.full(int(hit.sum()), reach[size])))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = doc = TaskContext.get().partitionId() << 40
        for batch in chunks(batches):
            words = words_of(batch.column(1))
            at, key, far = hits(words)
            out = []
            if len(at):
                offsets = buffer_of(batch.column(1))[1]
                text = np.searchsorted(words.first, at, "right") - 1
                low, high = np.maximum(at - far, words.first[text]), np.minimum(at + far, words.first[text + 1])
                order = np.lexsort((low, text))
                at, key, text, low, high = (x[order] for x in (at, key, text, low, high))
                # Parts that touch are one; documents lie one after the other.
                so_far = np.maximum.accumulate(high)
                new = np.append(True, (low[1:] > so_far[:-1]) | (text[1:] != text[:-1]))
                begins = np.append(np.flatnonzero(new), len(at))
                for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    t, a, b = int(text[i]), int(low[i]), int(high[i:j].max())
                    digest = hashlib.md5(batch.column(1)[t].as_buffer()).hexdigest()
                    edges = [(e[a:b] - offsets[t]).tobytes() for e in (words.starts, words.ends)]
                    out.append((row, doc + t, batch.column(0)[t].as_py(), digest, words.symbols[a:b].tobytes(), *edges, key[i:j].view(np.int64), at[i:j] - a))
                    row += 1
            doc += len(batch)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split(" ")[0] for f in SUSPECT.split(", ")]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, SUSPECT)


def _verified(rows: DataFrame) -> DataFrame:
    """The regions that hold their item: row, uid, distance, start_byte, end_byte."""
    names = ["row", "uid", "distance", "start_byte", "end_byte"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_uid, item, masks = None, [], {}
        for batch in batches:
            out = []
            for row, uid, data, region, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uid != known_uid:
                    known_uid, item, masks = uid, np.frombuffer(data, np.uint64).tolist(), defaultdict(int)
                    for i, symbol in enumerate(item):
                        masks[symbol] |= 1 << i
                symbols, edits = np.frombuffer(region, np.uint64).tolist(), edits_of(len(item))
                distance, end = edit_distance_within(masks, len(item), symbols)
                if distance <= edits:
                    a = max(0, end - len(item) - edits)
                    first = end - run_start(item, symbols[a:end])
                    out.append((row, uid, distance, int(np.frombuffer(starts, np.int64)[first]), int(np.frombuffer(ends, np.int64)[end - 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, "row long, uid string, distance int, start_byte long, end_byte long")


def _salted(rows: DataFrame) -> DataFrame:
    """Each row for every part over which the other side of a join is dealt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _salt() -> Column:
    return F.pmod(F.col("row"), F.lit(SALTS)).alias("salt")


FOUND = "doc_id long, digest string, item_id long, distance int, n_words int, start_byte long, end_byte long"


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``find_leaks`` with the digest of the document's text."""
    spark = docs.sparkSession
    ids = stage(item_table(benchmark), "items")
    items = ids.groupBy("uid").agg(F.first("symbols").alias("symbols"), F.first("n").alias("n"))
    keyed = stage(item_keys(items), "item-keys")
    facts = keyed.agg(F.count("key").alias("keys"), F.count("word").alias("words")).first()
    if not facts["keys"]:
        return spark.createDataFrame([], FOUND)
    # One row for each class.
    longest = keyed.groupBy("size").agg(F.max("n").alias("n")).collect()

    def bits(column: str, each: int):
        wanted = min(MOST_BITS, max(1 << 16, 1 << (each * facts[column + "s"] - 1).bit_length()))
        return spark.sparkContext.broadcast(bitmap_of(keyed.where(F.col(column).isNotNull()).select(column), wanted))

    known, keys = bits("word", WORD_BITS), bits("key", KEY_BITS)
    found = stage(suspects(docs, {r["size"]: 2 * r["n"] + 1 for r in longest}, known, keys), "suspects")
    for bitmap in (known, keys):
        bitmap.destroy()
    windows = found.select("row", _salt(), F.explode(F.arrays_zip("keys", "places")).alias("w")).select("row", "salt", F.col("w.keys").alias("key"), F.col("w.places").alias("place"))
    segments = _salted(keyed.where("key is not null").select("key", "uid", "n", "offset").distinct())
    edits = F.floor(F.col("n") / EDIT_EVERY)
    # Regions that start close to one another are one.
    start = F.floor((F.col("place") - F.col("offset") - edits) / (edits + 1)) * (edits + 1)
    regions = windows.join(segments, ["key", "salt"]).select("row", "salt", "uid", "n", start.alias("start")).distinct()
    regions = regions.select("row", "salt", "uid", F.greatest(F.col("start"), F.lit(0)).alias("first"), (F.col("start") + F.col("n") + 4 * edits + 1).alias("last"))
    regions = regions.where(F.col("last") > F.col("first"))
    part = lambda c: F.substring(F.col(c), (8 * F.col("first") + 1).cast("int"), (8 * (F.col("last") - F.col("first"))).cast("int")).alias(c)
    texts = found.select("row", "symbols", "starts", "ends")
    cut = regions.join(texts, "row").select("row", "salt", "uid", part("symbols").alias("region"), part("starts"), part("ends"))
    checked = cut.join(_salted(items.select("uid", "symbols")), ["uid", "salt"]).select("row", "uid", "symbols", "region", "starts", "ends")
    best = _verified(checked).join(found.select("row", "doc", "doc_id", "digest"), "row").groupBy("doc", "uid").agg(
        F.min(F.struct("distance", "start_byte", "end_byte")).alias("best"), F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest")
    )
    named = _salted(ids.select("uid", "item_id", F.col("n").alias("n_words")))
    return best.withColumn("salt", F.pmod(F.col("doc"), F.lit(SALTS))).join(named, ["uid", "salt"]).select(
        "doc_id", "digest", "item_id", "best.distance", "n_words", "best.start_byte", "best.end_byte"
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item in it: doc_id, item_id, distance, n_words (of the
    item), start_byte, end_byte of the item's best run found in the document.

    An item is in a document if some run of its words is within floor(n_words / 5) word
    edits; items of fewer than five words must appear unchanged.  Items without words and
    null texts match nothing.  Rows with a null or repeated doc_id are searched each;
    repeated items, and those with a null item_id, are reported each.  Other columns are
    ignored.
    """
    return _found(docs, benchmark).drop("digest")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Equal texts hold the same items, so documents meet the digests of those found.
    """
    digests = stage(_found(docs, benchmark).select(F.col("digest").alias("leaky")).distinct(), "leaky-texts")
    return docs.join(digests, F.md5(text_or_empty()) == F.col("leaky"), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
