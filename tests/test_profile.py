import statistics

import pytest
from pyspark.sql import functions as F

from tabwise.operators import profile, quantiles
from tabwise.operators.profile import column_profile


def by_column(df, value):
    return {r["column"]: r[value] for r in df.collect()}


def test_nulls_and_nan_are_missing(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (float("nan"), None), (None, "b")], "v double, s string"
    )
    assert by_column(profile.null_counts(df), "nulls") == {"v": 2, "s": 1}
    assert by_column(profile.numeric_summary(df), "mean") == {"v": 1.0}


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [(None, "x"), (None, "x"), ("x", None), ("x", None), ("x", None)], "a string, b string"
    )
    assert profile.duplicate_count(df).first()["duplicate_count"] == 3
    summary = profile.table_summary(df).first()
    assert (summary["row_count"], summary["total_nulls"], summary["duplicate_count"]) == (5, 5, 3)


def test_moved_text_is_not_a_duplicate(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc")], "a string, b string")
    assert profile.duplicate_count(df).first()["duplicate_count"] == 0


def test_duplicates_with_maps_and_arrays(spark):
    df = spark.range(4).select(
        F.create_map(F.lit("k"), F.col("id") % 2).alias("m"), F.array(F.lit(1)).alias("a")
    )
    assert profile.duplicate_count(df).first()["duplicate_count"] == 2


def test_quality_score(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert profile.quality_score(empty).first()["quality_score"] == 100
    # 3 of 8 cells missing: 15; 2 of 4 rows repeated: 15.
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    assert profile.quality_score(df).first()["quality_score"] == 70
    # 5 of 12 cells missing: 16.66, truncated after adding the repeats.
    df = spark.createDataFrame([(None, None, 1), (None, 2, 1), (3, None, None), (4, 5, 6)], "a int, b int, c int")
    assert profile.quality_score(df).first()["quality_score"] == 100 - int(5 / 12 * 40)
    # The score never falls below 50.
    df = spark.createDataFrame([(None,)] * 10, "a int")
    assert profile.quality_score(df).first()["quality_score"] == 50


def test_distinct_counts_of_every_type(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        (1, 0.0D, 'a', true, DATE'2020-01-01', TIMESTAMP'2020-01-01 00:00:00', X'01', 1.5BD),
        (1, -0.0D, 'A', true, DATE'2020-01-01', TIMESTAMP'2020-01-01 00:00:01', X'01', 1.50BD),
        (2, double('nan'), NULL, false, NULL, NULL, X'02', NULL),
        (NULL, NULL, 'a', NULL, NULL, NULL, NULL, NULL)
        AS t(i, d, s, b, day, ts, bin, dec)"""
    )
    assert by_column(profile.distinct_counts(df), "distinct") == {
        "i": 2, "d": 1, "s": 2, "b": 2, "day": 1, "ts": 2, "bin": 2, "dec": 1,
    }


def test_distinct_long_texts_differ_past_any_prefix(spark):
    df = spark.range(50).select(F.concat(F.repeat(F.lit("x"), 5000), F.col("id").cast("string")).alias("t"))
    assert profile.distinct_counts(df).first()["distinct"] == 50


def test_distinct_counts_of_all_null_column(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a string, b int")
    assert by_column(profile.distinct_counts(df), "distinct") == {"a": 0, "b": 2}


@pytest.mark.parametrize(
    "values",
    [
        [1.0],
        [1.0, 2.0],
        [3.0, 1.0, 2.0],
        [5.0] * 7 + [1.0] * 7,
        [5.0] * 8 + [1.0] * 7,
        [float(i * i % 101) for i in range(1000)],
        [1e18, -1e18] + [i / 7 for i in range(501)],
        [1e300, -1e300, 1.7e308, -1.7e308] + [1.0 + i * 1e-12 for i in range(64)],
        [1.0 + i * 2.0**-52 for i in range(33)],
        [0.0, -0.0, 1.0],
        [float("inf"), float("-inf")] + [float(i) for i in range(11)],
    ],
)
def test_exact_median_matches_sorting(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    assert quantiles.exact_medians(df, ["v"])["v"] == pytest.approx(
        statistics.median(values), rel=1e-15
    )


def test_medians_skip_nulls_and_take_several_columns(spark):
    df = spark.range(1001).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("even"),
        (F.col("id") % 3).alias("few"),
        F.lit(None).cast("double").alias("none"),
        F.exp(F.col("id") / 50).alias("skewed"),
    )
    found = quantiles.exact_medians(df, df.columns)
    assert found["even"] == 500.0 and found["few"] == 1.0 and found["none"] is None
    assert found["skewed"] == pytest.approx(2.718281828459045**10)


def test_hot_value_does_not_disturb_the_median(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1200, 7.0).otherwise(F.col("id") / 10).alias("v")
    )
    values = sorted(7.0 if i < 1200 else i / 10 for i in range(3000))
    assert quantiles.exact_medians(df, ["v"])["v"] == statistics.median(values)


def test_column_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.5, 2, "x"), (2.5, 3, "y")], "`unit.price` double, `net amount` int, `a`` b` string")
    found = {r["column"]: r for r in column_profile(df).collect()}
    assert found["unit.price"]["mean"] == 2.0
    assert found["net amount"]["median"] == 2.5
    assert found["a` b"]["distinct"] == 2


def test_nested_columns_have_no_statistics(spark):
    df = spark.range(3).select(F.array("id").alias("a"), F.struct("id").alias("s"), "id")
    found = {r["column"]: r for r in column_profile(df).collect()}
    assert found["a"]["kind"] == "nested" and found["a"]["distinct"] == 0
    assert found["a"]["mean"] is None and found["id"]["distinct"] == 3


def test_empty_table_profiles(spark):
    df = spark.createDataFrame([], "a int, b string, c double")
    found = {r["column"]: r for r in column_profile(df).collect()}
    assert found["a"]["rows"] == 0 and found["b"]["unique_ratio"] == 0.0
    assert found["c"]["median"] is None
    assert column_profile(df, exact=False).count() == 3


def test_fast_profile_recounts_decisive_columns(spark):
    df = spark.range(2000).select(
        F.col("id").alias("order_id"),
        (F.col("id") % 2).alias("flag"),
        (F.col("id") % 10).alias("ten"),
        (F.col("id") % 700).alias("many"),
    )
    exact = by_column(column_profile(df), "distinct")
    fast = by_column(column_profile(df, exact=False), "distinct")
    assert {c: fast[c] for c in ("order_id", "flag", "ten")} == {
        c: exact[c] for c in ("order_id", "flag", "ten")
    }
    assert fast["many"] == pytest.approx(700, rel=0.15)


def test_derived_metrics(spark):
    df = spark.createDataFrame([(10.0, 4), (5.0, 0), (None, 2)], "amount double, q int")
    found = profile.derived_metrics(df, {"unit": ("amount", "q")}).collect()
    assert [r["unit"] for r in found] == [2.5, None, None]
