"""Infinities, NaN, texts equal to a digest, staging without a shared folder."""

import hashlib

import pytest

from tabwise.operators import quantiles

from tabwise.functions import staging
from tabwise.operators.charts import correlation_matrix
from tabwise.operators.profile import distinct_counts, duplicate_count
from tabwise.operators.rules import outlier_rows

INF = float("inf")


def test_a_column_with_an_infinity_has_no_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(INF,)], "v double")
    assert outlier_rows(df, ["v"]).count() == 0


def test_correlation_with_an_infinity_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, INF), (3.0, 1.0)], "a double, b double")
    rows = correlation_matrix(df, ["a", "b"]).collect()
    assert {r["r"] for r in rows if r["col_a"] != r["col_b"]} == {0.0}


def test_nan_and_null_are_one_value(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None)], "k int, v double")
    assert duplicate_count(df).first()[0] == 1


def test_a_text_and_its_digest_are_two_values(spark):
    text = "x" * 80
    df = spark.createDataFrame([(text,), (hashlib.sha256(text.encode()).hexdigest(),)], "v string")
    assert [r for r in distinct_counts(df).collect()][0][1] == 2


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "a"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())


@pytest.mark.parametrize(
    "values",
    [
        [1e308, 1.2e308, 1.3e308, 1.6e308],
        [float("-inf"), 1.7976931348623157e308, float("inf"), float("inf"), 5e-324],
        [5e-324, 1e-323, 0.0, -5e-324, 1e-322],
        [s * 10.0**e for e in range(-30, 31) for s in (1, -1, 3)],
        [1.0 + k * 2.0**-52 for k in range(9)] + [1e300, -1e300, 1e-300],
    ],
)
def test_medians_end_in_bounded_passes(spark, monkeypatch, values):
    passes, split = [], quantiles._split
    monkeypatch.setattr(quantiles, "_split", lambda *a: passes.append(1) or split(*a))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    low, high = ordered[(len(values) - 1) // 2], ordered[len(values) // 2]
    assert quantiles.exact_medians(df, ["v"])["v"] == (low if low == high else low / 2 + high / 2)
    assert len(passes) <= 8
