import pytest
from pyspark.sql import functions as F

from tabwise.operators import roles
from tabwise.operators.profile import column_profile


def assigned(df, **options):
    found = roles.assign_roles(column_profile(df), **options)
    return {r["column"]: r for r in found.collect()}


def role_of(df, **options):
    return {c: r["role"] for c, r in assigned(df, **options).items()}


def test_role_precedence(spark):
    df = spark.range(100).select(
        F.col("id").alias("order_id"),
        (F.col("id") % 3).alias("customer_id"),
        (F.col("id") % 3).alias("user_id"),
        F.concat(F.lit("EMP"), F.col("id") % 4).alias("code"),
        F.col("id").cast("double").alias("key_float"),
        (F.col("id") % 2).alias("flag"),
        F.when(F.col("id") % 2 == 0, "yes").otherwise("maybe").alias("reply"),
        F.when(F.col("id") % 2 == 0, "left").otherwise("right").alias("lane"),
        F.lit("2025-01-02").alias("when"),
        (F.col("id") * 60).alias("uptime"),
        (F.col("id") * 1.5).alias("amount"),
        F.concat(F.lit("a rather long sentence about "), F.col("id").cast("string")).alias("story"),
        F.concat(F.lit("a rather long sentence about "), (F.col("id") % 3).cast("string")).alias("phrase"),
        F.col("id").cast("timestamp").alias("seen"),
        (F.col("id") > 5).alias("good"),
        F.array("id").alias("list"),
    )
    assert role_of(df) == {
        "order_id": "Identifier", "customer_id": "Identifier", "user_id": "Numerical",
        "code": "Identifier", "key_float": "Numerical", "flag": "Boolean", "reply": "Boolean",
        "lane": "Categorical", "when": "Date", "uptime": "Date", "amount": "Numerical",
        "story": "Text", "phrase": "Categorical", "seen": "Date", "good": "Boolean",
        "list": "Categorical",
    }


def test_nullable_integer_identifier_option(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (6,), (7,), (8,), (9,), (None,)], "order_key int")
    assert role_of(df) == {"order_key": "Identifier"}
    assert role_of(df, nullable_ints_are_floats=True) == {"order_key": "Numerical"}


def test_date_list_spares_money_words(spark):
    df = spark.createDataFrame([(2020, 10, 1.0), (2021, 20, 2.0)], "Year int, TenureDays int, MonthlyIncome double")
    found = assigned(df)
    assert found["Year"]["is_date"] and found["TenureDays"]["is_date"]
    assert not found["MonthlyIncome"]["is_date"] and found["MonthlyIncome"]["is_numeric"]


def test_keys(spark):
    df = spark.range(100).select(
        F.col("id").alias("invoice_no"), (F.col("id") % 5).alias("shop_id"), F.lit(1).alias("code")
    )
    found = assigned(df)
    assert found["invoice_no"]["is_primary_key"] and not found["invoice_no"]["is_foreign_key"]
    assert found["shop_id"]["is_foreign_key"] and found["code"]["is_foreign_key"]


@pytest.mark.parametrize(
    "values, expected",
    [
        ([0.0, 0.5, 1.05], True),
        ([0.0, 50.0, 105.0], True),
        ([0.0, 106.0], False),
        ([-0.1, 0.5], False),
        ([0.0, 1.2], False),
        ([None, None], False),
    ],
)
def test_percentage_ranges(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "tax_rate double")
    assert assigned(df)["tax_rate"]["is_percentage"] is expected


def test_target_words_can_be_switched_off(spark):
    df = spark.createDataFrame([("a",), ("b",)], "Category string")
    assert assigned(df)["Category"]["is_target"]
    assert not assigned(df, target_words=())["Category"]["is_target"]


def test_relationships_and_mapping(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "x", 5), ("b", 2.0, "x", 6), ("b", 3.5, "z", 9)],
        "segment string, amount double, region string, units int",
    )
    cp = roles.assign_roles(column_profile(df))
    pairs = {(r["x_col"], r["y_col"], r["unique_x_count"]) for r in roles.relationships(cp).collect()}
    assert pairs == {
        ("segment", "amount", 2), ("segment", "units", 2), ("region", "amount", 2), ("region", "units", 2),
    }
    mapped = {(r["concept"], r["column"]) for r in roles.bi_mapping(cp).collect()}
    assert ("financial_columns", "amount") in mapped and ("geographic_columns", "region") in mapped
    assert ("dimensions", "segment") in mapped and ("dimensions", "region") not in mapped


def test_domain(spark):
    def names(*columns):
        return spark.createDataFrame([(c,) for c in columns], "column string")

    def domain(mode, *columns):
        return roles.detect_domain(names(*columns), mode).first()["domain"]

    assert domain("substring", "Employee_ID", "total_price") == "Sales & Revenue"
    assert domain("substring", "Salary") == "Human Resources"
    assert domain("substring", "CustomerState") == "Customer Churn"
    assert domain("substring", "weight") == "Operations Performance"
    assert domain("exact", "Tenure", "x") == "HR"
    assert domain("exact", "EBITDA") == "Finance"
    assert domain("exact", "total_price") == "General Operations"
    with pytest.raises(ValueError):
        domain("other", "x")


def test_chart_candidates(spark):
    df = spark.range(60).select(
        (F.col("id") % 3).cast("string").alias("segment"),
        (F.col("id") * 1.5).alias("a"), (F.col("id") * 2.5).alias("b"), (F.col("id") * 3.5).alias("c"),
    )
    cp = roles.assign_roles(column_profile(df))
    found = [(r["chart_id"], r["chart_type"]) for r in roles.chart_candidates(cp, 10).orderBy("pos").collect()]
    assert found == [
        ("bar_segment_a", "bar"), ("bar_segment_b", "bar"), ("pie_segment", "pie"),
        ("scatter_a_b", "scatter"), ("correlation_heatmap", "heatmap"),
    ]
    assert roles.chart_candidates(cp).count() == 4
