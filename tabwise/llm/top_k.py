"""Exact top-k by inner product over an impact-ordered index, score at a time.

The index holds vectors in blocks.  In a block every dimension is a posting list of the
vectors, by falling component, cut into segments of one quantised impact.  A query takes
segments of all dimensions by what they can add at most, the largest first, and adds up
scores as it goes.  Once no segment that is left can add anything, the sum so far is the
most that a vector can reach.  The query stops in a block only when few vectors can still
reach the k-th best score found, which proves that no other is among the best; these few
are scored again exactly.

Blocks of queries meet slices of index blocks in Spark; a slice's best carry over from
block to block, so later blocks stop sooner.  No task holds more than a block of queries
and two blocks of vectors; the work grows with queries times vectors, as asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwise.functions.staging import stage
from tabwise.llm.common import table

SCALE = 64
#: Vectors of an index block, impacts of a posting list, index blocks of a slice.
BLOCK, LEVELS, SLICE_BLOCKS = 16384, 16, 1
QUERY_BLOCK = 1024
#: Shares of the segments that can only lower scores, after which a query looks whether it
#: may stop; those that can raise them are always taken.
CHECKS = (0, 1 / 8, 1 / 4, 1 / 2, 1)
#: A query stops when at most this share of the block's vectors has to be scored again:
#: that costs less than the segments left.
FEW = 1 / 5
#: Whole numbers below this are exact as doubles.
EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, row (a number of its own for each row), values: floor(scale * x) of each
    component.  Vectors that are null or hold a null or non-finite component are left out."""
    embedding = F.col("embedding").cast("array<double>")
    valid = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & F.coalesce(valid, F.lit(False))).select(
        "vec_id", F.monotonically_increasing_id().alias("row"), F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("values")
    )


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """The lists as rows; shorter ones end in zeros."""
    edges = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(edges)
    flat = column.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]]
    out = np.zeros((len(column), dims), np.int64)
    at = np.repeat(np.arange(len(column)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(edges[:-1] - edges[0], sizes)] = flat
    return out


_BLOCK_FIELDS = ["block", "n", "ids", "rows", "matrix"]


def _blocks(vectors: DataFrame, size: int, rows: int, dims: int) -> DataFrame:
    """The rows, dealt evenly, in blocks of about ``size``: block, n, ids, rows, matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            ids = pa.array([ids.to_pylist()], pa.list_(pa.int64()))
            parts = [np.concatenate([h[i] for h in held]) for i in (1, 2)]
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([len(parts[0])]), ids, *[pa.array([p.tobytes()], pa.binary()) for p in parts]], _BLOCK_FIELDS
            )

        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.slice(start, size)
                held.append((part.column(0), part.column(1).to_numpy(), _matrix(part.column(2), dims)))
                if sum(len(h[1]) for h in held) >= 2 * size:
                    yield emit()
                    held = []
        if held:
            yield emit()

    return vectors.repartition(max(1, -(-rows // size))).mapInArrow(run, "block long, n long, ids array<long>, rows binary, matrix binary")


class ImpactIndex:
    """A block of vectors as posting lists by falling component, in segments of one
    quantised impact."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.rows, self.matrix = ids, rows, matrix
        n, dims = matrix.shape
        self.n, self.dims = n, dims
        self.vector = np.argsort(-matrix, axis=0, kind="stable").T  # dims x n
        values = np.take_along_axis(matrix.T, self.vector, 1)
        top, low = values[:, :1], values[:, -1:]
        width = np.maximum(1, -(-(top - low + 1) // LEVELS))
        level = (top - values) // width
        flat = np.arange(dims)[:, None] * LEVELS + level
        self.sizes = np.bincount(flat.ravel(), minlength=dims * LEVELS)
        self.starts = np.append(0, np.cumsum(self.sizes))[:-1]
        self.vector, self.values = self.vector.ravel(), values.ravel()
        filled = self.sizes > 0
        self.high, self.low = np.zeros(dims * LEVELS, np.int64), np.zeros(dims * LEVELS, np.int64)
        self.high[filled] = self.values[self.starts[filled]]
        self.low[filled] = self.values[(self.starts + self.sizes - 1)[filled]]
        self.values = self.values.astype(float)
        self.dim = np.repeat(np.arange(dims), LEVELS)
        self.doubles = matrix.astype(float)
        self.added = np.zeros(n)  # used again by each query
        self.largest = np.abs(values).max(axis=1) if n else np.zeros(dims)

    def best(self, query: np.ndarray, own: int, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of vectors that may be among the k best, given the falling
        scores ``known`` of k vectors elsewhere (or fewer); ``own`` is the query's row."""
        weight = query[self.dim]
        used = np.flatnonzero((self.sizes > 0) & (weight != 0))
        bound = np.where(weight > 0, weight * self.high, weight * self.low)[used]
        order = np.argsort(-bound, kind="stable")
        bound, segments = bound[order], used[order]
        limit = float((np.abs(query) * self.largest).sum())  # no score or part of one is larger
        score, slack, read = np.zeros(self.n), 1e-12 * limit, [0] * self.dims
        floor, taken = known[k - 1] if len(known) >= k else None, 0
        raising = int(np.count_nonzero(bound > 0))
        for share in CHECKS:
            upto = raising + math.ceil(share * (len(segments) - raising))
            if upto > taken:
                now = segments[taken:upto]
                # In a dimension the segments taken follow one another, from the end where
                # they add most: they are read in one go.  None holds a vector twice.
                postings = np.bincount(self.dim[now], self.sizes[now], self.dims).astype(np.int64)
                for d in np.flatnonzero(postings).tolist():
                    n, w = int(postings[d]), float(query[d])
                    a = d * self.n + (read[d] if w > 0 else self.n - read[d] - n)
                    added = np.multiply(self.values[a : a + n], w, out=self.added[:n])
                    np.add.at(score, self.vector[a : a + n], added)
                    read[d] += n
                taken = upto
            if floor is None or taken == len(segments):
                likely = np.argpartition(-score, 2 * k)[: 2 * k] if self.n > 2 * k else np.arange(self.n)
                likely = likely[self.rows[likely] != own]
                scores = np.sort(np.append(self.scores(likely, query, limit), known))[::-1]
                floor = int(scores[k - 1]) if len(scores) >= k else None
            able = np.ones(self.n, bool) if floor is None else score >= floor - slack
            if np.count_nonzero(able) <= max(2 * k, FEW * self.n):
                break
        places = np.flatnonzero(able & (self.rows != own))
        return self.scores(places, query, limit), places

    def scores(self, places: np.ndarray, query: np.ndarray, limit: float) -> np.ndarray:
        """Exact inner products; through doubles where these hold all sums."""
        if limit < EXACT:
            return (self.doubles[places] @ query.astype(float)).astype(np.int64)
        return self.matrix[places] @ query


def _leaders(k: int, held: tuple, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple:
    """The k best of both; ties to the smaller id (none last), then the smaller row."""
    scores, ids, rows = (np.concatenate(p) for p in zip(held, (scores, ids, rows), strict=True))
    order = np.lexsort((rows, ids, -scores))[:k]
    return scores[order], ids[order], rows[order]


_NO_ID = np.iinfo(np.int64).max


def _ids(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def search(vectors: DataFrame, is_query: F.Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each query.

    ``vectors`` as ``integer_vectors`` gives them, staged; rows with ``is_query`` are the
    queries.  The score is the inner product in 64-bit whole numbers; of vectors of
    different lengths the shorter one ends in zeros.  Ties go to the smaller vec_id, null
    last.  Of rows that repeat a vec_id each is a candidate for the other, and each that is
    a query has its own k rows.
    """
    facts = vectors.agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries"), F.max(F.size("values")).alias("dims")).first()
    schema = "query_id long, query_row long, vec_id long, row long, score long"
    dims = max(1, facts["dims"] or 0)
    index = stage(_blocks(vectors, BLOCK, facts["rows"], dims), "impact-index")
    queries = stage(_blocks(vectors.where(is_query), QUERY_BLOCK, facts["queries"], dims), "query-blocks")
    slices = max(1, -(-facts["rows"] // (BLOCK * SLICE_BLOCKS)))
    parts = max(1, -(-facts["queries"] // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    fields = ["n", "ids", "rows", "matrix"]
    asked = queries.select(F.col("block").alias("part"), every(slices).alias("slice"), F.lit(0).alias("side"), *fields)
    held = index.select(every(parts).alias("part"), (F.col("block") % slices).alias("slice"), F.lit(1).alias("side"), *fields)
    place = ["part", "slice"]
    dealt = asked.unionByName(held).repartition(slices * parts, *place).sortWithinPartitions(*place, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, asked_rows, waiting = None, [], []

        def load(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows, matrix = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (5, 6))
            return _ids(batch.column(4), i), rows, matrix.reshape(-1, dims)

        def meet() -> None:
            """The waiting vectors, small blocks together, against all queries."""
            if not waiting:
                return
            block = ImpactIndex(*(np.concatenate(p) for p in zip(*waiting, strict=True)))
            waiting.clear()
            for query in asked_rows:
                scores, places = block.best(query[2], query[1], k, query[3][0])
                query[3] = _leaders(k, query[3], scores, block.ids[places], block.rows[places])

        def results() -> Iterator[pa.RecordBatch]:
            meet()
            found = [q for q in asked_rows if len(q[3][0])]
            if found:
                n = [len(q[3][0]) for q in found]
                score, ids, rows = (np.concatenate([q[3][i] for q in found]) for i in range(3))
                columns = [np.repeat([q[0] for q in found], n), np.repeat([q[1] for q in found], n), ids, rows, score]
                arrays = [pa.array(c, pa.int64(), mask=ids == _NO_ID if i == 2 else None) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "query_row", "vec_id", "row", "score"])

        for batch in batches:
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != pair:
                    yield from results()
                    pair, asked_rows = key, []
                if batch.column(2)[i].as_py() == 0:
                    none = np.zeros(0, np.int64)
                    asked_rows += [[int(a), int(b), v, (none, none, none)] for a, b, v in zip(*load(batch, i), strict=True)]
                elif asked_rows:
                    waiting.append(load(batch, i))
                    if sum(len(w[1]) for w in waiting) >= BLOCK:
                        meet()
        yield from results()

    found = dealt.select("part", "slice", "side", "n", *fields[1:]).mapInArrow(run, schema)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: F.Column, k: int, scale: int = SCALE) -> DataFrame:
    """``search`` over a table of vec_id and embedding; other columns are ignored, as are
    vectors that are null or hold null or non-finite components.  An empty vector scores
    0.  A null vec_id is a candidate, and a query only if ``is_query`` holds for it."""
    return search(stage(integer_vectors(vectors, scale), "vectors"), F.coalesce(is_query, F.lit(False)), k)


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.r ORDER BY s DESC, c.vec_id, c.r)::INT AS rank, c.vec_id, s AS score
FROM v q JOIN v c ON q.r <> c.r, LATERAL (SELECT list_inner_product(q.x, c.x)::BIGINT AS s)
WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20
"""
