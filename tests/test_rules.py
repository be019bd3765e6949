import pytest

from tabwise.operators import governance, rules
from tabwise.operators.profile import column_profile
from tabwise.operators.roles import assign_roles


def values(spark, *numbers):
    return spark.createDataFrame([(float(n) if n is not None else None,) for n in numbers], "v double")


def test_negative_rule(spark, rows):
    df = spark.createDataFrame([(-1.0, 2), (-2.0, -1), (None, 3)], "price double, n int")
    found = rules.negative_rule(df, ["price"]).first()
    assert found["n_rows"] == 2 and found["severity"] == "WARNING"
    assert found["violation_desc"] == "Found 2 negative entries in 'price'. Values must be >= 0."
    assert rules.negative_rule(df, []).count() == 0


def test_columns_of_the_negative_rule(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", 4)], "UnitPrice double, weight double, income_group string, quantity int")
    cp = assign_roles(column_profile(df))
    assert rules.non_negative_columns(cp) == ["UnitPrice", "quantity"]
    assert rules.list_numeric(cp) == ["UnitPrice", "weight", "quantity"]


def test_outliers_need_more_than_five_values(spark):
    assert rules.outlier_rule(values(spark, 1, 1, 1, 1, 1000), ["v"]).count() == 0
    # With few rows no value reaches three sample deviations.
    many = values(spark, *([1, 2] * 20), 1000, None)
    found = rules.outlier_rule(many, ["v"]).first()
    assert found["n_rows"] == 1 and found["severity"] == "INFO"
    row = rules.outlier_rows(many, ["v"]).first()
    assert row["outlier_value"] == 1000.0 and row["z"] > 3


def test_constant_column_has_no_outliers(spark):
    df = values(spark, *([1] * 30))
    assert rules.outlier_rule(df, ["v"]).count() == 0
    assert rules.outlier_rows(df, ["v"]).count() == 0


def test_row_can_be_outlying_in_two_columns(spark, rows):
    data = [(1.0 + i % 3, 5.0 - i % 2, i) for i in range(60)] + [(900.0, -900.0, 99)]
    df = spark.createDataFrame(data, "a double, b double, k int")
    assert rows(rules.outlier_rows(df, ["a", "b"], keep=["k"]), "k", "column") == [(99, "a"), (99, "b")]


def test_report_counts_warnings_only(spark):
    data = [(1.0 + i % 3,) for i in range(60)] + [(-900.0,), (-1.0,)]
    df = spark.createDataFrame(data, "amount double")
    report = rules.violation_report(rules.violations(df, ["amount"], ["amount"]))
    assert tuple(report.first()) == (2, 2, True)


@pytest.mark.parametrize("n, score, status", [(0, 100, "APPROVED"), (3, 85, "APPROVED_WITH_WARNINGS"), (50, 60, "APPROVED_WITH_WARNINGS")])
def test_governance_score(spark, n, score, status):
    report = spark.createDataFrame([(1, n, True)], "violation_entries bigint, total_violations_count bigint, validation_passed boolean")
    cert = governance.governance_score(report).first()
    assert (cert["overall_confidence_score"], cert["status"]) == (score, status)
