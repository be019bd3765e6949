"""Phrases that occur more often than their parts would by chance, by dynamic itemset counting.

Texts become streams of word ids in shards.  The shards are scanned in turn, round and
round, one a step, and phrases of all lengths are counted side by side: words from the
first step on, a longer phrase from the step after both of its subphrases (all but the
last word, all but the first) reached the threshold.  Each is counted over one full cycle,
so over every shard once, and the scans end when no phrase is left that is not through.

- The counts of the last cycle, added up, never exceed a phrase's count over all texts, and
  equal it once its cycle is full.  So what reaches the threshold is known at once, and
  its largest sum is its exact count.
- Tasks know what has reached the threshold from two bitmaps of fixed size, of all such
  phrases and of those of the last cycle.  A bit set by chance only has a phrase counted
  for nothing: its sums are still no larger than its count.
- A phrase's key is the 64-bit hashes of its words in a row; hashes take in the language.
  Two words of a language with one hash (a chance of 1e-7 in a million words) would be
  counted as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.functions.staging import scratch_path, stage
from tabwise.llm.common import SpanHash, buffer_of, chunks, mix, spans, table, text_or_empty

#: Shards of a cycle.
SHARDS = 3
#: Bytes of text in a row of a stream.
STREAM_BYTES = 2 << 20
#: Bits of a bitmap for each phrase in it, and of the largest bitmap (16 MB).
BITS_EACH, MOST_BITS = 32, 1 << 27

_B = np.arange(256)
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
_BLANK = (_B == 32) | (_B == 9)
#: What ends a piece of text.
_STOP = np.isin(_B, list(b".,;:!?\n\x0b\x0c\r"))

STREAM = "lang string, shard int, n_words long, ids binary, hashes array<long>, words array<string>"


def _stream(texts: pa.Array, lang: str) -> tuple[int, np.ndarray, np.ndarray, pa.Array]:
    """Number of words, ids (0 between pieces, else a place in the lists, from 1), and the
    distinct words' hashes and texts."""
    data, offsets = buffer_of(texts)
    low = _LOWER[data]
    stop = _STOP[data]
    starts, ends = spans(~(stop | _BLANK[data]), offsets)
    salt = SpanHash(np.frombuffer(lang.encode(), np.uint8))(np.array([0]), np.array([len(lang.encode())]))
    found, first, place = np.unique(mix(SpanHash(low)(starts, ends) ^ salt), return_index=True, return_inverse=True)
    piece = np.cumsum(stop)[starts] + np.searchsorted(offsets, starts, "right")
    ids = np.zeros(len(starts) + int((piece[1:] != piece[:-1]).sum()), "<u4")
    if len(starts):
        ids[np.arange(len(starts)) + np.append(0, np.cumsum(piece[1:] != piece[:-1]))] = place + 1
    sizes = (ends - starts)[first]
    edges = np.append(0, np.cumsum(sizes)).astype(np.int64)
    letters = low[np.repeat(starts[first] - edges[:-1], sizes) + np.arange(edges[-1])]
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(letters)))
    return len(starts), ids, found.astype(np.uint64), words.cast(pa.string())


def streams(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The word streams, written by shard: a row for each language of about ``STREAM_BYTES``
    of text.  A-Z are lower-cased; a null lang is ``und``; documents are never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in chunks(batches, size=STREAM_BYTES):
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).take(pa.array(np.flatnonzero(codes == code)))
                n, ids, hashes, words = _stream(texts, lang)
                if n:
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), v) for v in (pa.array(hashes.view(np.int64)), words)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([turn % shards], pa.int32()), pa.array([n], pa.int64()), pa.array([ids.tobytes()], pa.binary()), *lists],
                        ["lang", "shard", "n_words", "ids", "hashes", "words"],
                    )
                turn += 1

    spark = docs.sparkSession
    path = scratch_path(spark, "word-streams")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs.select(lang.alias("lang"), text_or_empty().alias("text")).mapInArrow(run, STREAM).write.partitionBy("shard").parquet(path)
    return spark.read.schema(STREAM).parquet(path)


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return mix(key * np.uint64(3) + word)


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(ids: np.ndarray, vocabulary: np.ndarray, known: np.ndarray | None, recent: np.ndarray | None, first_cycle: bool, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys as rows of word hashes, counts) of the phrases of a stream that are being counted."""
    if first_cycle:
        yield vocabulary[1:, None], np.bincount(ids, minlength=len(vocabulary))[1:]
    if known is None:
        return
    word = vocabulary[ids]
    in_known, in_recent = _set(known, vocabulary), _set(recent, vocabulary)
    in_known[0] = in_recent[0] = False  # between pieces
    a, r, key = in_known[ids], in_recent[ids], word
    for k in range(2, longest + 1):
        # ``a`` and ``r``: whether the phrase of k - 1 words that starts here reached the threshold, and of late.
        at = np.flatnonzero(a[:-1] & a[1:])
        if not len(at):
            return
        found = _longer(key[at], word[at + k - 1])
        open_ = r[at] | r[at + 1]
        places, hashes = at[open_], found[open_]
        if len(places):
            _, first, n = np.unique(hashes, return_index=True, return_counts=True)
            yield word[places[first][:, None] + np.arange(k)], n
        if k == longest:
            return
        a, r, key = np.zeros(len(ids), bool), np.zeros(len(ids), bool), np.zeros(len(ids), np.uint64)
        key[at] = found
        a[at] = _set(known, found)
        r[at] = a[at] & _set(recent, found)


def _key_array(keys: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(keys.astype(">u8"))
    edges = np.arange(len(keys) + 1, dtype=np.int32) * 8 * keys.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _scan(rows: DataFrame, bitmaps, first_cycle: bool, longest: int) -> DataFrame:
    """lang, key, n: the counts of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, recent = bitmaps.value if bitmaps is not None else (None, None)
        for batch in batches:
            for i, lang in enumerate(batch.column(0).to_pylist()):
                ids = np.frombuffer(batch.column(1)[i].as_buffer(), "<u4").astype(np.int64)
                vocabulary = np.append(np.zeros(1, np.uint64), batch.column(2)[i].values.to_numpy().view(np.uint64))
                for keys, n in _counted(ids, vocabulary, known, recent, first_cycle, longest):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), _key_array(keys), pa.array(n.astype(np.int64))], ["lang", "key", "n"]
                    )

    counts = rows.select("lang", "ids", "hashes").mapInArrow(run, "lang string, key binary, n long")
    return counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _hashed(reached: DataFrame) -> DataFrame:
    """h and step of each phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.zeros(len(batch), np.uint64)
            sizes = np.diff(np.frombuffer(batch.column(0).buffers()[1], np.int32)[batch.column(0).offset :][: len(batch) + 1])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                words = np.frombuffer(b"".join(batch.column(0).take(pa.array(rows)).to_pylist()), ">u8").reshape(len(rows), -1).astype(np.uint64)
                key = words[:, 0]
                for k in range(1, words.shape[1]):
                    key = _longer(key, words[:, k])
                hashes[rows] = key
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(1)], ["h", "step"])

    return reached.select("key", "step").mapInArrow(run, "h long, step int")


def _bitmaps(reached: DataFrame, phrases: int, oldest: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all phrases and of those since step ``oldest``; at most ``MOST_BITS`` each, so
    the driver gets bytes that do not grow with the texts."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * phrases - 1).bit_length()))
    slots = _hashed(reached).select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("slot"), "step")
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(bit).alias("known"), F.coalesce(F.bit_or(F.when(F.col("step") >= oldest, bit)), F.lit(0)).cast("long").alias("recent")
    ).toArrow()
    out = []
    for name in ("known", "recent"):
        full = np.zeros(bits // 64, "<i8")
        full[words["word"].to_numpy()] = words[name].to_numpy()
        out.append(full.view(np.uint8))
    return out[0], out[1]


def frequent_phrases(texts: DataFrame, threshold: int, longest: int, shards: int = SHARDS) -> DataFrame:
    """lang, key, f, step: the phrases of 1 to ``longest`` words that occur ``threshold``
    times or more, their exact counts, and the step at which they reached the threshold."""
    spark = texts.sparkSession
    window: list[DataFrame] = []
    reached, bitmaps, step = None, None, 0
    while True:
        step += 1
        rows = texts.where(F.col("shard") == (step - 1) % shards)
        window = [*window, stage(_scan(rows, bitmaps, step <= shards, longest), "phrase-counts")][-shards:]
        cycle = window[0]
        for part in window[1:]:
            cycle = cycle.unionByName(part)
        found = cycle.groupBy("lang", "key").agg(F.sum("n").alias("f")).where(F.col("f") >= threshold)
        found = found.withColumn("step", F.lit(step))
        if reached is not None:
            found = reached.unionByName(found).groupBy("lang", "key").agg(F.max("f").alias("f"), F.min("step").alias("step"))
        reached = stage(found, "frequent-phrases")
        if bitmaps is not None:
            bitmaps.destroy()
            bitmaps = None
        # Phrases of full length open nothing.
        shorter = reached.where(F.octet_length("key") < 8 * longest)
        oldest = step + 1 - shards
        seen = shorter.agg(F.count("*").alias("n"), F.count_if(F.col("step") >= oldest).alias("recent")).first()
        if step >= shards and not seen["recent"]:
            return reached
        if seen["n"]:
            bitmaps = spark.sparkContext.broadcast(_bitmaps(shorter, seen["n"], oldest))


def mine_collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: each language's best phrases of 2 to
    ``longest`` words that occur ``threshold`` times or more.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and those into
    words at spaces and tabs.  a, l and r count all occurrences of the phrase, of its first
    ``cut`` words and of the rest, n all words of the language.  The score floor(1000 * a *
    n / (l * r)) is that of the cut with the lowest, ties to the first.  A phrase that a
    longer one with the same count holds is left out.  Ranks go by score and a descending,
    then by the phrase's bytes.  A null lang is ``und``, a null text empty; ids do not
    matter and repeated rows count each; no words give no rows; other columns are ignored.
    """
    texts = streams(docs)
    facts = frequent_phrases(texts, threshold, longest).select("lang", "key", "f")
    phrases = facts.where(F.octet_length("key") >= 16).withColumnRenamed("f", "a")
    # What a longer phrase with the same count holds, one with one word more holds.
    within = phrases.where(F.octet_length("key") >= 24).select(
        "lang", "a", F.explode(F.array(F.expr("substring(key, 1, octet_length(key) - 8)"), F.expr("substring(key, 9)"))).alias("key")
    )
    kept = phrases.join(within, ["lang", "key", "a"], "left_anti")
    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1, octet_length(key) div 8 - 1)"))).withColumns(
        {"left": F.expr("substring(key, 1, 8 * cut)"), "right": F.expr("substring(key, 8 * cut + 1)")}
    )
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(facts.select("lang", F.col("key").alias(side), F.col("f").alias(count)), ["lang", side])
    totals = texts.groupBy("lang").agg(F.sum("n_words").alias("n"))
    wide = {c: F.col(c).cast("decimal(17,0)") for c in ("a", "l", "r", "n")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    scored = cuts.join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "key", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "key", "a", "n", "best.*")
    # Ties at the end are kept until the texts are there.
    leading = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    leaders = stage(best.withColumn("place", F.rank().over(leading)).where(F.col("place") <= top).drop("place"), "leading-phrases")
    hashes = F.expr("transform(sequence(0, octet_length(key) div 8 - 1), i -> cast(conv(hex(substring(key, 8 * i + 1, 8)), 16, -10) AS bigint))")
    parts = leaders.select("lang", "key", F.posexplode(hashes).alias("pos", "hash"))
    pairs = texts.select("lang", F.explode(F.arrays_zip("hashes", "words")).alias("w")).select(
        "lang", F.col("w.hashes").alias("hash"), F.col("w.words").alias("word")
    )
    words = pairs.join(parts.select("lang", "hash").distinct(), ["lang", "hash"], "left_semi").groupBy("lang", "hash").agg(F.min("word").alias("word"))
    named = parts.join(words, ["lang", "hash"]).groupBy("lang", "key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("phrase")
    )
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        leaders.join(named, ["lang", "key"])
        .withColumn("rank", F.row_number().over(ranked).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS lengths(k))
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
inner_parts AS (
  SELECT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM c WHERE k > 2
), kept AS (SELECT * FROM c ANTI JOIN inner_parts USING (lang, phrase, a)),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, lf.f AS l, rf.f AS r, n, cut, ((1000::HUGEINT * a * n) // (lf.f::HUGEINT * rf.f))::BIGINT AS score
  FROM cuts JOIN f lf ON lf.lang = cuts.lang AND lf.phrase = x JOIN f rf ON rf.lang = cuts.lang AND rf.phrase = y
    JOIN totals ON totals.lang = cuts.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, cut
FROM best QUALIFY rank <= 2000
"""
