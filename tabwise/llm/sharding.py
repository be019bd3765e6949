"""Minimax contiguous sharding: the smallest capacity that lets atomic groups, in
their order, fill a given number of shards.

Equal texts form one atomic group, ordered by the digest of the text, so that every
shard is a random part of the corpus and no key or source piles up.  The groups'
running byte sums are written once, sorted.  The capacity is found by a bracketed
search that tests ``PROBES`` capacities at a time: one greedy step for all of them is
one look-up, "the last boundary at or below start + capacity", over a table whose
sorted files let the filter skip all but a few.  Once few boundaries lie between the
cuts of the largest infeasible and the smallest feasible capacity, these alone are
read, and the search ends exactly.

Everything is DataFrame functions; the driver sees capacities and cuts, and at most
``NEAR`` boundaries.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabwise.functions.staging import stage
from tabwise.llm.common import shuffle_partitions, table, text_or_empty

SHARDS = 24
PROBES = 24
NEAR = 100_000
#: Hex digits of a digest that name the bucket within which running sums are taken.
BUCKET_DIGITS = 3
#: Parts of a shard that are numbered apart.
CELLS = 64
#: Bytes a document takes besides its text.
OVERHEAD = 8


def _bucket(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, BUCKET_DIGITS), 16, 10).cast("int")


def text_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, size, text_crc32; a null text counts as empty."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id"),
        F.sha2(text, 256).alias("digest"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def _running(groups: DataFrame) -> DataFrame:
    """Each group's running sum of bytes, up to and with itself, in digest order.

    A bucket's sums are taken in one window task; buckets split the digests evenly,
    and the offsets between them are one row per bucket.
    """
    groups = groups.withColumn("bucket", _bucket(F.col("digest")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.groupBy("bucket").agg(F.sum("bytes").alias("b")).select(
        "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0")
    )
    within = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    return (
        groups.withColumn("b", F.sum("bytes").over(within))
        .join(F.broadcast(offsets), "bucket")  # at most 16 ** BUCKET_DIGITS rows
        .select("digest", "bytes", (F.col("b0") + F.col("b")).alias("ends"))
    )


class _Boundaries:
    """Look-ups among the groups' running sums."""

    def __init__(self, groups: DataFrame) -> None:
        self.ends = groups.select("ends")

    def last_at_most(self, targets: list[int], low: int) -> list[int]:
        """For each target, the last boundary at or below it; ``low`` if none is above that."""
        picks = [F.max(F.when(F.col("ends") <= t, F.col("ends"))).alias(f"t{i}") for i, t in enumerate(targets)]
        row = self.ends.where((F.col("ends") > low) & (F.col("ends") <= max(targets))).agg(*picks).first()
        return [low if v is None else v for v in row]

    def between(self, ranges: list[tuple[int, int]]) -> list[int] | None:
        """All boundaries within the ranges, in order; None if more than ``NEAR``."""
        near = F.lit(False)
        for low, high in ranges:
            near |= F.col("ends").between(low, high)
        found = [r[0] for r in self.ends.where(near).limit(NEAR + 1).collect()]
        return sorted(found) if len(found) <= NEAR else None


def smallest_capacity(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity with which ``shards`` contiguous runs hold all groups, and the
    ``shards - 1`` cuts of the greedy filling at that capacity (as running sums)."""
    top = groups.agg(F.max("ends").alias("total"), F.max("bytes").alias("largest")).first()
    total, largest = top["total"] or 0, top["largest"] or 0
    if not total:
        return 0, [0] * (shards - 1)
    at = _Boundaries(groups)
    # Greedy runs of capacity c are each fuller than c - largest, so high is feasible.
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    cuts: dict[int, list[int]] = {}

    def fill(capacities: list[int]) -> None:
        starts = {c: 0 for c in capacities}
        for c in capacities:
            cuts[c] = []
        for _ in range(shards):
            found = at.last_at_most([starts[c] + c for c in capacities], min(starts.values()))
            for c, end in zip(capacities, found, strict=True):
                starts[c] = max(end, starts[c])
                cuts[c].append(starts[c])

    while True:
        step = max(1, (high - low) // (PROBES - 1))
        probes = sorted({*range(low, high, step), high})
        fill(probes)
        feasible = [c for c in probes if cuts[c][-1] == total]
        high = feasible[0]
        below = [c for c in probes if c < high]
        if not below or below[-1] == high - 1:
            return high, cuts[high][:-1]
        low = below[-1]
        known = at.between(list(zip(cuts[low], cuts[high], strict=True)))
        if known is not None:
            break

    def greedy(c: int) -> list[int]:
        out, start = [], 0
        for _ in range(shards):
            i = bisect_right(known, start + c)
            start = max(start, known[i - 1] if i else 0)
            out.append(start)
        return out

    capacity = low + 1 + bisect_left(range(low + 1, high), True, key=lambda c: greedy(c)[-1] == total)
    return capacity, greedy(capacity)[:-1]


def even_cuts(groups: DataFrame, shards: int, capacity: int) -> list[int]:
    """Cuts that keep every shard within ``capacity`` and spread what is spare.

    The greedy filling leaves all slack to the last shard.  Here each shard takes up to
    an even share of what is left, unless the shards after it could then not hold the
    rest: then it takes up to the capacity.
    """
    total = groups.agg(F.max("ends")).first()[0] or 0
    at = _Boundaries(groups)
    # From the end: the least boundary from which the last j shards still hold the rest.
    needed, edge = [total], total
    for _ in range(shards - 1):
        row = at.ends.where((F.col("ends") >= edge - capacity) & (F.col("ends") <= edge)).agg(F.min("ends")).first()
        edge = 0 if edge <= capacity else row[0]
        needed.append(edge)
    needed = needed[::-1]
    cuts, start = [], 0
    for j in range(shards - 1):
        share = start + (total - start) // (shards - j)
        row = at.ends.where((F.col("ends") > start) & (F.col("ends") <= start + capacity)).agg(
            F.max(F.when(F.col("ends") <= share, F.col("ends"))).alias("under"),
            F.min(F.when(F.col("ends") > share, F.col("ends"))).alias("over"),
        ).first()
        options = [x for x in (row["under"], row["over"]) if x is not None] or [start]
        best = min(options, key=lambda x: (abs(x - share), x))
        start = max(best, needed[j])
        cuts.append(start)
    return cuts


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``bytes``: the largest shard is as small as contiguous runs of whole groups
    allow.  All rows of equal text share a shard; a null text counts as an
    empty one.  ``slot``
    numbers a shard's rows from 0; repeated rows get a slot each.  An empty table gives
    no rows; with fewer groups than shards some shards stay empty.  Rows with a null
    doc_id are dealt like any other.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = text_sizes(docs)
    groups = stage(
        _running(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
        .repartitionByRange(shuffle_partitions(spark), "ends")
        .sortWithinPartitions("ends"),
        "shard-groups",
    )
    capacity, _ = smallest_capacity(groups, shards)
    cuts = even_cuts(groups, shards, capacity)
    # The groups are in the order of their digests, so a row's digest tells its shard.
    last = {r["ends"]: r["digest"] for r in groups.where(F.col("ends").isin(cuts)).collect()}
    shard = F.lit(0)
    for cut in cuts:
        shard += F.lit(1) if cut == 0 else (F.col("digest") > last[cut]).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard")).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("shard", "cell").orderBy("doc_id")
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(first), ["shard", "cell"])  # at most shards * CELLS rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
