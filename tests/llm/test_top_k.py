"""Exact top-k against scoring every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import top_k


def plain(rows, every, k):
    """(query_id, rank, vec_id, score), by scoring all pairs of rows."""
    valid = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(valid):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), (j is None, j), j) for c, (j, w) in enumerate(valid) if c != q]
        scored.sort(key=lambda s: s[:2])
        out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], "vec_id long, embedding array<float>, row int, values string")


@pytest.mark.parametrize("block, k", [(4096, 20), (40, 5), (64, 3)])
def test_results_equal_all_pairs(spark, monkeypatch, block, k):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", block // 2)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in (centres[i % 6] + 0.3 * rng.normal(size=12)) * 0.3]) for i in range(500)]
    rows += [(600 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(3, rows[3][1]), (5, rows[9][1]), (0, rows[0][1])]  # repeated ids, one of them a query's
    rows += [(None, rows[1][1]), (1000, None), (1001, [None, 1.0]), (1005, [float("nan"), 0.0]), (1010, [float("inf")]), (1015, []), (1020, [0.5, 0.25]), (1025, [1e6] * 12)]
    got = top_k.nearest(frame_of(spark, rows).repartition(4), F.col("vec_id") % 5 == 0, k).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 5, k)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5])]
    got = top_k.nearest(frame_of(spark, rows), F.col("vec_id") % 20 == 0, 20).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 32 + 128 * 32)]
    for few in (rows[:1], rows[1:], [], [(0, None)]):
        assert top_k.nearest(frame_of(spark, few), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_a_query_stops_before_the_end(monkeypatch):
    """On clustered vectors the proof comes before all postings are read."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32)) * 12
    matrix = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 2).astype(np.int64)
    index = top_k.ImpactIndex(np.arange(4000), np.arange(4000), matrix)
    read = []
    multiply = np.multiply
    monkeypatch.setattr(top_k.np, "multiply", lambda x, *a, **k: (read.append(len(x)), multiply(x, *a, **k))[1])
    for q in random.Random(2).sample(range(4000), 20):
        read.clear()
        scores, places = index.best(matrix[q], q, 10, np.zeros(0, np.int64))
        want = np.sort(np.delete(matrix @ matrix[q], q))[::-1][:10]
        assert (np.sort(scores)[::-1][:10] == want).all()
        assert sum(read) < matrix.size
