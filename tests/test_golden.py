"""Two small CSV samples from end to end, against values computed by hand.

Set TABWISE_SAMPLES to the folder that holds them; skipped where it is unset.
"""

import os

import pytest

from tabwise.operators.charts import correlation_matrix
from tabwise.plans.analysis import discover, execute
from tabwise.sources.readers import read_table

FOLDER = os.environ.get("TABWISE_SAMPLES", "")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample files are absent")


@pytest.fixture(scope="module")
def sales(spark):
    df = read_table(spark, f"{FOLDER}/sample_sales.csv")
    found = discover(df)
    pairs = [("Date", "Amount"), ("Category", "Amount"), ("Region", "Amount"), ("Category", None), (None, None)]
    return found, execute(df, found, pairs)


@pytest.fixture(scope="module")
def hr(spark):
    df = read_table(spark, f"{FOLDER}/sample_hr.csv")
    found = discover(df)
    return found, execute(df, found, [("Department", "MonthlyIncome"), ("Attrition", "Age")])


def columns(found):
    return {r["column"]: r for r in found.columns.collect()}


def tagged(found, tag):
    return {c for c, r in columns(found).items() if r[tag]}


def series(results, chart_id):
    picked = results.charts.where(f"chart_id = '{chart_id}'").orderBy("pos").collect()
    return [(r["label"], round(r["value"], 2)) for r in picked]


def test_sales_discovery(sales):
    found, _ = sales
    assert found.domain == "Sales & Revenue"
    assert {c: r["role"] for c, r in columns(found).items()} == {
        "Date": "Date", "Category": "Categorical", "Region": "Categorical", "Amount": "Numerical",
        "Quantity": "Numerical",
    }
    assert {c: r["distinct"] for c, r in columns(found).items()} == {
        "Date": 83, "Category": 5, "Region": 4, "Amount": 144, "Quantity": 9,
    }
    assert tagged(found, "is_currency") == {"Amount"} and tagged(found, "is_geo") == {"Region"}
    assert tagged(found, "is_target") == {"Category", "Quantity"}
    amount = columns(found)["Amount"]
    assert (round(amount["mean"], 6), amount["min_num"], amount["max_num"], amount["median"]) == (
        609.918194, -250.0, 1189.08, 615.94,
    )
    assert tuple(found.summary.first()) == (150, 5, 9, 0, 100)
    steps = found.time_series.first()
    assert (steps["min_date"], steps["max_date"], steps["estimated_frequency"]) == (
        "2025-01-01", "2025-04-27", "Irregular",
    )


def test_sales_results(sales):
    _, results = sales
    assert tuple(results.reconciliation.first()) == (150, 150, 0, 100.0)
    found = results.violations.collect()
    assert [(r["column"], r["severity"], r["n_rows"]) for r in found] == [("Amount", "WARNING", 1)]
    assert [round(r["value"], 6) for r in results.kpis.orderBy("pos").collect()] == [
        91523.86, 700.0, 610.159067,
    ]
    assert series(results, "chart_Date_Amount_line") == [
        ("2025-01", 25010.36), ("2025-02", 22838.94), ("2025-03", 25178.95), ("2025-04", 18495.61),
    ]
    assert series(results, "chart_Category_Amount_bar") == [
        ("Electronics", 25920.35), ("Apparel", 24664.49), ("Office Supplies", 19147.58),
        ("Furniture", 14931.95), ("Software", 6506.56), ("Unknown", 352.93),
    ]
    assert series(results, "chart_Region_Amount_bar")[0] == ("Latin America", 29325.85)
    assert series(results, "chart_Category_None_pie") == [
        ("Electronics", 45), ("Apparel", 37), ("Office Supplies", 30), ("Furniture", 24),
        ("Software", 11), ("Unknown", 3),
    ]
    r = correlation_matrix(results.cleaned, ["Amount", "Quantity"]).where("col_a < col_b").first()["r"]
    assert round(r, 9) == 0.096004728


def test_hr_discovery(hr):
    found, _ = hr
    assert found.domain == "Human Resources" and found.time_series is None
    assert {c: r["role"] for c, r in columns(found).items()} == {
        "Employee_ID": "Identifier", "Age": "Numerical", "Department": "Categorical",
        "MonthlyIncome": "Numerical", "Attrition": "Boolean", "Tenure": "Numerical",
    }
    assert tagged(found, "is_primary_key") == {"Employee_ID"}
    assert tagged(found, "is_currency") == {"MonthlyIncome"}
    assert tagged(found, "is_target") == {"Employee_ID", "MonthlyIncome", "Attrition"}


def test_hr_results(hr):
    _, results = hr
    found = results.violations.collect()
    assert [(r["column"], r["severity"], r["n_rows"]) for r in found] == [("Age", "INFO", 1)]
    assert results.report.first()["total_violations_count"] == 0
    assert [round(r["value"], 6) for r in results.kpis.orderBy("pos").collect()] == [
        120.0, 15.833333, 9423.758333,
    ]
    assert series(results, "chart_Department_MonthlyIncome_bar") == [
        ("Research & Development", 494466), ("Engineering", 222890), ("Sales", 215437),
        ("Marketing", 119310), ("Human Resources", 78748),
    ]
    assert series(results, "chart_Attrition_Age_bar") == [("No", 3900), ("Yes", 825)]
    found = correlation_matrix(results.cleaned, ["Age", "MonthlyIncome", "Tenure"])
    r = {(x["col_a"], x["col_b"]): round(x["r"], 6) for x in found.collect()}
    assert (r["Age", "MonthlyIncome"], r["Age", "Tenure"], r["MonthlyIncome", "Tenure"]) == (
        0.061589, -0.116320, -0.005698,
    )


def test_outputs_are_written(spark, hr, tmp_path):
    _, results = hr
    paths = results.write(str(tmp_path / "out"))
    assert spark.read.parquet(paths["cleaned_data"]).count() == 120
    audit = {r["metric"]: r["value"] for r in spark.read.parquet(paths["governance_audit"]).collect()}
    assert audit["Signoff Audit Status"] == "APPROVED" and audit["Audited Compliance Score"] == "100%"
    assert spark.read.parquet(paths["kpi_scorecard"]).count() == 3
    assert spark.read.json(paths["charts"]).count() == 2


def test_full_run_with_defaults(spark, sales):
    found, _ = sales
    df = read_table(spark, f"{FOLDER}/sample_sales.csv")
    results = execute(df, found, certificate="formula")
    assert results.certificate.first()["overall_confidence_score"] == 95
    assert 1 <= len(results.planned) <= 6 and results.insights.count() >= 1
    with pytest.raises(ValueError):
        execute(df, found, certificate="other")
