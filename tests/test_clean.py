from pyspark.sql import functions as F

from tabwise.operators import clean
from tabwise.operators.profile import column_profile
from tabwise.operators.roles import assign_roles


def roled(df):
    return assign_roles(column_profile(df))


def test_duplicates_go_before_trimming(spark, rows):
    df = spark.createDataFrame([("a ", 1), ("a", 1), ("a", 1), (None, 1), (None, 1)], "s string, n int")
    assert rows(clean.drop_duplicates(df)) == [("a ", 1), ("a", 1), (None, 1)]
    assert clean.clean(df, roled(df)).where("s = 'a'").count() == 2


def test_duplicates_with_maps(spark):
    df = spark.range(6).select(F.create_map(F.lit("k"), F.col("id") % 2).alias("m"))
    assert clean.drop_duplicates(df).count() == 2


def test_median_is_taken_after_deduplication(spark, rows):
    data = [("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 3.0), ("c", 8.0), ("d", None)]
    df = spark.createDataFrame(data, "s string, v double")
    cleaned = clean.clean(df, roled(df))
    assert rows(cleaned.where("s = 'd'"), "v") == [(3.0,)]


def test_impute_median(spark, rows):
    df = spark.createDataFrame([(1, None), (2, None), (None, None)], "i int, d double")
    filled = clean.impute_median(df, ["i", "d"])
    assert rows(filled) == [(1.0, 0.0), (1.5, 0.0), (2.0, 0.0)]
    whole = clean.impute_median(spark.createDataFrame([(1,), (3,), (None,)], "i int"), ["i"])
    assert whole.schema["i"].dataType.simpleString() == "int"
    assert rows(whole) == [(1,), (2,), (3,)]
    given = clean.impute_median(df, ["i"], {"i": 9.0})
    assert rows(given, "i") == [(1,), (2,), (9,)]


def test_nan_is_imputed(spark, rows):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "v double")
    assert rows(clean.impute_median(df, ["v"])) == [(1.0,), (2.0,), (3.0,)]


def test_fill_and_trim(spark, rows):
    df = spark.createDataFrame([("\t a b \n",), (None,), ("",)], "s string")
    assert rows(clean.fill_unknown(df, ["s"]).transform(clean.trim_text, ["s"])) == [
        ("",), ("Unknown",), ("a b",),
    ]


def test_dates_in_every_shape(spark, rows):
    texts = ["2025-04-13", "2025/4/3", "04/13/2025", "junk", "2025-02-30", None]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "d string, i int")
    got = [r[0] for r in clean.standardize_dates(df, ["d"]).orderBy("i").collect()]
    assert got == ["2025-04-13", "2025-04-03", "2025-04-13", None, None, None]


def test_numeric_date_columns_are_left_alone(spark, rows):
    df = spark.createDataFrame([(2020, 1.0), (2021, 2.0), (None, 3.0)], "Year int, v double")
    cleaned = clean.clean(df, roled(df))
    assert rows(cleaned, "Year") == [(2020,), (2021,), (None,)]


def test_boolean_with_gaps_becomes_text(spark, rows):
    df = spark.createDataFrame([(True, 1), (False, 2), (None, 3)], "ok boolean, n int")
    assert rows(clean.clean(df, roled(df)), "ok") == [("False",), ("True",), ("Unknown",)]


def test_cleaning_is_idempotent_and_leaves_no_gaps(spark, rows):
    df = spark.range(300).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("units"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit(" s"), F.col("id") % 3)).alias("segment"),
        F.when(F.col("id") % 4 > 0, F.lit("2025/1/2")).otherwise("bad").alias("date"),
    )
    once = clean.clean(df, roled(df))
    twice = clean.clean(once, roled(once))
    assert once.where("units IS NULL OR segment IS NULL").count() == 0
    assert rows(clean.drop_duplicates(once)) == rows(twice)


def test_reconcile(spark):
    before, after = spark.range(8), spark.range(6)
    assert tuple(clean.reconcile(before, after).first()) == (8, 6, 2, 75.0)
    empty = spark.range(0)
    assert tuple(clean.reconcile(empty, empty).first()) == (0, 0, 0, None)
