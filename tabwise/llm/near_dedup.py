"""Near-duplicates by bottom-k sketches of one hash function.

1. Each document's shingles are hashed once; the ``K`` least hashes are its sketch.
   Documents with the same set form one node.
2. Inverted lists of retained values give the candidates.  Similar sets share at least
   half of their sketches (but for a chance of 1e-6), so a node is listed only under the
   rarer half of its values: values common to many texts, as of a line that all repeat,
   list nobody.  A digest of one bit per bin of the set, carried in the lists, drops
   chance meetings.
3. The sketch of the union of a candidate pair, which the two sketches give, estimates
   the similarity; pairs clearly below the threshold are dropped.
4. The full sets confirm the rest exactly.

A list of many members is not paired out.  First every member meets the pivot of the
list, and what is linked is contracted into components; what is left meets a member of the
list's largest component.  Then a node that still shares a
list with a larger component is compared with that component's full sets, block by
block; small components that share a list lie in blocks together.  So a group of copies
costs about its size, and no link between components is left unchecked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.staging import scratch_path, stage
from tabwise.llm.common import chunks, shuffle_partitions, table, text_or_empty
from tabwise.llm.shingles import shingle_sets

K = 48
PERCENT = 80
#: Digest bits of a set, in 64-bit words.
WORDS = 4
#: How far an estimate from sketches may lie below the similarity (5 sigma at K values).
MARGIN = 5 * (0.8 * 0.2 / K) ** 0.5
#: Members of a list that one row holds when components search each other.
LIST_PART = 4000
#: Sets that are compared at once.
BLOCK = 500
#: Lists at least this part as long as a node's longest may be the home of its group.
LONG = 0.8


def _digest_bits(values: np.ndarray) -> list[int]:
    """One bit for each of 64 * WORDS bins: of the least value in the bin, the lowest bit
    that does not name the bin; 0 for an empty bin."""
    bins = (values % np.uint64(64 * WORDS)).astype(np.int64)[::-1]
    least = np.zeros(64 * WORDS, np.uint64)
    least[bins] = values[::-1]  # values ascend, so the least is written last
    bit = (least // np.uint64(64 * WORDS)) & np.uint64(1)
    return np.packbits(bit.astype(np.uint8), bitorder="little").view("<i8").tolist()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), key (digest of the set), bits, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n, key, bits, sketch = [], [], [], []
            for values in shingle_sets(batch.column(1), words):
                n.append(len(values))
                key.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                bits.append(_digest_bits(values))
                sketch.append(values[:K].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                ["doc_id", "n", "key", "bits", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n long, key binary, bits array<long>, sketch array<long>"
    )


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, packed: the sets of the documents named in ``wanted`` (column node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            packed = [v.astype("<u8").tobytes() for v in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "packed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_or_empty().alias("text"))
    # A merge join at every size: the wanted ones may be as many as the documents.
    return texts.join(wanted.hint("merge"), "node", "left_semi").mapInArrow(run, "node long, packed binary")


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u8")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def stage_by_node(df: DataFrame, name: str) -> DataFrame:
    """A staged table in buckets of ``node``, so that joins on it move only the other side."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    title = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(shuffle_partitions(spark), "node").format("parquet").option("path", path).saveAsTable(title)
    try:
        return spark.table(title)  # resolved here, with its buckets
    finally:
        spark.sql(f"DROP TABLE {title}")  # the catalog's entry; the files are at the path


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """node, bits, n, weight, v: a row per node with the (value, count) it is listed under,
    the rarer half of its sketch.

    ``count`` is how many nodes retain the value; values of a single node are left out.
    ``weight`` tells how much company a node has.  ``_entries`` makes the lists' rows.
    """
    postings = nodes.select("node", F.explode("sketch").alias("value"))
    counts = postings.groupBy("value").agg(F.count("*").alias("count")).where("count > 1")
    shared = postings.join(counts, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("v"))
    size = F.least(F.col("n"), F.lit(K)).cast("int")
    # Sharing at least half of the values means sharing one of the rarest size // 2 + 1;
    # values of this node alone are the rarest of all.
    listed = F.slice("v", 1, F.greatest(F.lit(0), F.floor(size / 2).cast("int") + 1 - (size - F.size("v"))))
    return (
        nodes.join(shared, "node")
        .select("node", "bits", "n", listed.alias("v"))
        .where(F.size("v") > 0)
        .withColumn("weight", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["count"]))
    )


def _entries(lists: DataFrame) -> DataFrame:
    """A row per node and value, with ``value`` and ``count`` in place of ``v``."""
    return lists.withColumn("e", F.explode("v")).withColumns({"value": F.col("e.value"), "count": F.col("e.count")}).drop("v", "e")


def _may_link(bits_a: Column, n_a: Column, bits_b: Column, n_b: Column, percent: int) -> Column:
    """Whether sizes and digest bits allow a link.

    In a linked pair a fifth of the filled bins at most may hold different least values,
    half of which differ in their bit: five sigma more than that are let pass.
    """
    different = sum((F.bit_count(F.get(bits_a, i).bitwiseXOR(F.get(bits_b, i))) for i in range(WORDS)), F.lit(0))
    apart = (100 - percent) / 100
    filled = F.least(F.lit(64.0 * WORDS), F.greatest(n_a, n_b) * (100 / percent))
    allowed = F.least(apart * filled, apart / 2 * filled + 5 * F.sqrt(apart / 2 * (1 - apart / 2) * filled)) + 1
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (different <= allowed)


def _pivot_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each list's members with its pivot, the one with the most company."""
    pivots = entries.groupBy("value").agg(
        F.max_by(F.struct("node", "bits", "n"), F.struct("weight", "node")).alias("p"), F.count("*").alias("length")
    ).where("length > 1")
    met = entries.join(pivots, "value").where(
        (F.col("node") != F.col("p.node")) & _may_link(F.col("bits"), F.col("n"), F.col("p.bits"), F.col("p.n"), percent)
    )
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _power_of_two(x: Column) -> Column:
    """The least power of two that is no smaller."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), x)))).cast("long")


def _share(pieces: Column) -> Column:
    """The node's piece of a list or group; of a finer cut it lies within that of a coarser one."""
    return F.pmod(F.xxhash64("node"), _power_of_two(pieces))


def _grouped(members: DataFrame) -> DataFrame:
    """Adds group and block, in which other nodes search a node.

    A component of ``BLOCK`` nodes or more is a group.  The nodes of smaller ones lie
    together by one of the longest lists that each is in, so many texts with a passage in
    common are searched block by block too, not one by one.
    """
    large = F.col("members") >= BLOCK
    longest = F.get("v", F.size("v") - 1)["count"]
    near_longest = F.filter("v", lambda x: x["count"] >= LONG * longest)
    home = F.array_min(F.transform(near_longest, lambda x: x["value"]))
    members = members.withColumn("group", F.when(large, F.col("label")).otherwise(home))
    # Groups that need no second block are not looked up.
    sizes = members.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    sized = members.join(sizes, "group", "left").withColumn("block", _share(F.coalesce("size", F.lit(1)) / BLOCK))
    return sized.drop("size")


def _second_pivots(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): each list's members outside its largest component with one node of that
    component, picked by hash: most copies that the first pivot missed are linked to it."""
    order = F.struct("members", "label")
    heads = entries.groupBy("value").agg(
        F.min(order).alias("least"), F.max(order).alias("largest"),
        F.max_by(F.struct("node", "bits", "n"), F.struct("members", "label", F.xxhash64("node", "value"))).alias("p"),
    ).where("least <> largest")
    met = entries.join(heads, "value").where(
        (order < F.col("largest")) & _may_link(F.col("bits"), F.col("n"), F.col("p.bits"), F.col("p.n"), percent)
    )
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _searches(entries: DataFrame, percent: int) -> DataFrame:
    """(b, group, block): each node, with every block that may hold a node linked to it of
    a larger component.

    Of two components the smaller one's nodes search the other.  ``entries`` carry each
    node's label, its component's number of members, its group and block.  A list lies in
    parts of about ``LIST_PART`` nodes; nodes below the list's largest component look through
    all its parts, and what they find is named by group and block.  Joins are between parts,
    not nodes.
    """
    # A value's count bounds its list, so parts can be dealt without the list's length.
    part = _share(F.col("count") / LIST_PART)
    member = F.struct("node", "bits", "n", F.struct("members", "label").alias("order"), "group", "block")
    parts = stage(
        entries.select("value", part.alias("part"), member.alias("m")).groupBy("value", "part")
        .agg(F.collect_list("m").alias("nodes"), F.min("m.order").alias("lo"), F.max("m.order").alias("hi")),
        "list-parts",
    )
    heads = parts.groupBy("value").agg(
        F.min("lo").alias("least"), F.max("hi").alias("largest"), F.sum(F.size("nodes")).alias("length"), F.collect_list("part").alias("parts")
    )
    # A list of two is done: one was the other's pivot.
    mixed = heads.where("least <> largest and length > 2").select("value", "largest", "parts")
    seeking = (
        parts.join(mixed, "value")
        .select("value", F.filter("nodes", lambda m: m["order"] < F.col("largest")).alias("seekers"), "parts")
        .where(F.size("seekers") > 0)
        .select("value", "seekers", F.explode("parts").alias("part"))
    )

    def blocks_for(b: Column) -> Column:
        near = F.filter("nodes", lambda m: (m["order"] > b["order"]) & _may_link(m["bits"], m["n"], b["bits"], b["n"], percent))
        return F.array_distinct(F.transform(near, lambda m: F.struct(m["group"].alias("group"), m["block"].alias("block"))))

    met = seeking.join(parts.select("value", "part", "nodes"), ["value", "part"]).select(
        F.filter(
            F.transform("seekers", lambda b: F.struct(b["node"].alias("b"), blocks_for(b).alias("blocks"))),
            lambda found: F.size(found["blocks"]) > 0,
        ).alias("found")
    )
    return _each_block_once(met.select(F.explode("found").alias("f")).select("f.b", "f.blocks"))


def _each_block_once(found: DataFrame) -> DataFrame:
    """(b, group, block), each once, from rows (b, blocks).

    Similar nodes share many lists, and each list names the same blocks: a node's blocks
    are united before they become rows.
    """
    united = found.groupBy("b").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    return united.select("b", F.explode("blocks").alias("at")).select("b", "at.group", "at.block")


def _search_links(searches: DataFrame, members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): for each search, one linked node of each of the block's components that has any.

    ``members``: node, label, group, block.  The full sets of a block meet its searchers,
    which lie in teams, over the block's own inverted index; nothing is sampled, and no
    task holds more than a block.  Only blocks that somebody searches are read.
    """
    at = ["group", "block"]
    teams = searches.groupBy(at).agg(F.ceil(F.count("*") / BLOCK).alias("teams"))
    inside = stage(members.select("node", "label", *at).join(teams, at), "searched")
    nodes = inside.select("node").union(searches.select("b")).distinct()
    sets = stage_by_node(full_sets(docs, nodes, words), "sets")
    held = inside.withColumn("team", F.explode(F.sequence(F.lit(0).cast("long"), F.col("teams") - 1)))
    seekers = searches.withColumnRenamed("b", "node").join(teams, at).withColumn("team", F.pmod(F.xxhash64("node"), F.col("teams")))
    seekers = seekers.withColumn("label", F.lit(None).cast("long"))

    def with_sets(rows: DataFrame, side: int) -> DataFrame:
        return rows.join(sets, "node").select(*at, "team", F.lit(side).alias("side"), "node", "packed", "label")

    both = with_sets(held, 0).unionByName(with_sets(seekers, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, labels, arrays, index = None, [], [], [], None
        for batch in batches:
            links = []
            for *key, side, node, packed, label in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if key != group:
                    group, ids, labels, arrays, index = key, [], [], [], None
                if side == 0:
                    ids.append(node)
                    labels.append(label)
                    arrays.append(_unpack(packed))
                    continue
                if index is None and ids:
                    index = _BlockIndex(arrays, labels)
                hits = index.linked(_unpack(packed), percent) if ids else ()
                links += [(ids[hit], node) for hit in hits if ids[hit] != node]
            columns = list(zip(*links, strict=True)) if links else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    order = ["group", "block", "team"]
    return both.repartition(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "side").mapInArrow(run, "a long, b long")


class _BlockIndex:
    """The inverted index of a block of sets, with the components they are known to be in."""

    def __init__(self, sets: list[np.ndarray], labels: list[int]) -> None:
        self.sizes, self.labels = np.array([len(x) for x in sets]), np.array(labels)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def linked(self, found: np.ndarray, percent: int) -> list[int]:
        """The place of one set linked to ``found`` for each component that has any."""
        low, high = np.searchsorted(self.values, found), np.searchsorted(self.values, found, "right")
        runs = high - low
        at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        hits = np.flatnonzero(100 * common >= percent * (self.sizes + len(found) - common))
        return hits[np.unique(self.labels[hits], return_index=True)[1]].tolist()


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union's sketch does not rule the link out."""
    one = nodes.select(F.col("node"), F.col("sketch"), F.col("n"))
    joined = (
        pairs.join(one.withColumnsRenamed({"node": "a", "sketch": "sa", "n": "na"}), "a")
        .join(one.withColumnsRenamed({"node": "b", "sketch": "sb", "n": "nb"}), "b")
    )
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    share = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) / F.size(union)
    return joined.where(share >= percent / 100 - MARGIN).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = _unpack(x.as_py()), _unpack(y.as_py())
                common = _common(a, b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    joined = pairs.join(sets.withColumnsRenamed({"node": "a", "packed": "pa"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "packed": "pb"}), "b"
    )
    return joined.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable over the edges (a, b)."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b")))
    both = stage(edges.select(ends.alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    for step in count(1):
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old")
        )
        if step > 2:  # long chains: also go to the label's label
            jumps = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
            near = near.join(jumps, "label", "left").select("node", F.least("label", "jump").alias("label"), "old")
        labels = stage(near, "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")


def _relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after more edges, whose ends are contracted to their labels first."""
    for end in ("a", "b"):
        edges = edges.join(labels.withColumnsRenamed({"node": end}), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    joined = components(edges.where("a <> b").select("a", "b")).withColumnsRenamed({"node": "old", "label": "new"})
    moved = labels.withColumnsRenamed({"label": "old"}).join(joined, "old", "left").select("node", F.coalesce("new", "old").alias("label"))
    fresh = joined.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return stage(moved.unionByName(fresh), "labels")


def _members(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of lists with their label and how many nodes share it.

    Labels and sizes meet the nodes, not the many list rows of each; a node without a link
    is alone.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    return lists.join(labels.join(sizes, "label"), "node", "left").withColumns(
        {"label": F.coalesce("label", "node"), "members": F.coalesce("members", F.lit(1))}
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Documents are linked where 100 * intersection >= percent * union of their sets of
    ``words``-word shingles; ``component_id`` is the least doc_id reachable over links.
    Texts that are null, empty or white space have no shingles and are linked with
    nothing.  Rows that repeat a doc_id carry one id, so each is kept where that id is.
    A row with a null doc_id links nothing; it gets the component of documents with the
    same set, if there are any, and is never the one kept.  Other columns are ignored.
    """
    sketched = stage(sketches(docs, words), "sketches")
    nodes = stage_by_node(
        sketched.where("doc_id is not null and key is not null").groupBy("key")
        .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"))
        .repartition(shuffle_partitions(docs.sparkSession), "node"),  # one task, one bucket: few files
        "nodes",
    )
    lists = stage(inverted_lists(nodes), "lists")
    labels = None
    for pivots in (_pivot_pairs, _second_pivots):
        rows = lists if labels is None else _members(lists, labels)
        pairs = stage(_estimated(pivots(_entries(rows), percent), nodes, percent), "pairs")
        named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        links = _confirmed(pairs, stage_by_node(full_sets(docs, named, words), "sets"), percent)
        labels = components(links) if labels is None else _relabel(labels, links)
    members = _grouped(_members(lists, labels))
    searches = stage(_searches(_entries(members), percent), "searches")
    inside = members.select("node", "label", "group", "block")
    labels = _relabel(labels, _search_links(searches, inside, docs, words, percent))
    node_of = nodes.select("key", "node")
    node_of = node_of.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("component_id"))
    return (
        sketched.select("doc_id", "n", "key").join(node_of, "key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words]
    ELSE list_transform(range(1, len(words)), lambda i: words[i:i + 1]) END) AS shingle FROM w
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    JOIN c cx ON cx.doc_id = x.doc_id JOIN c cy ON cy.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, cx.n, cy.n HAVING 100 * count(*) >= 80 * (cx.n + cy.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM component LEFT JOIN c USING (doc_id)
"""
