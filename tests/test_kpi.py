import pytest

from tabwise.functions.kpi_tables import KpiSpec
from tabwise.operators import insights, kpi
from tabwise.operators.charts import Chart


def shown(df):
    return {r["title"]: r["display"] for r in df.collect()}


def test_sales(spark):
    df = spark.createDataFrame([(1, 1000.25, 2), (2, 250.5, 3), (3, None, 4)], "weight int, amount double, qty int")
    found = kpi.domain_kpis(df, "Sales & Revenue", ["weight", "amount", "qty"])
    assert shown(found) == {
        "Total Revenue": "$1,250.75", "Total Volume": "9", "Average Ticket Size": "$625.38",
    }


def test_sales_without_volume_column_counts_rows(spark):
    df = spark.createDataFrame([(1.0,)] * 1200, "price double")
    assert shown(kpi.domain_kpis(df, "Sales", ["price"]))["Total Volume"] == "1,200"
    floats = spark.createDataFrame([(1.0, 1.25), (1.0, 1000.5)], "price double, quantity double")
    found = kpi.domain_kpis(floats, "Sales", ["price", "quantity"])
    assert shown(found)["Total Volume"] == "1,001.75"


def test_rates(spark):
    df = spark.createDataFrame([("YES", 10.0), ("no", 20.0), ("churn", 30.0), (None, 40.0)], "churned string, pay double")
    hr = kpi.domain_kpis(df, "Human Resources", ["pay"], ["churned"])
    assert shown(hr)["Attrition Rate"] == "25.0%"
    churn = kpi.domain_kpis(df, "Customer Churn", ["pay"], ["churned"])
    assert shown(churn)["Customer Churn Rate"] == "50.0%"


def test_no_columns_at_all(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert shown(kpi.domain_kpis(df, "Sales", [])) == {
        "Total Revenue": "$0.00", "Total Volume": "1", "Average Ticket Size": "$0.00",
    }
    assert shown(kpi.domain_kpis(df, "HR", []))["Attrition Rate"] == "0.0%"
    empty = spark.createDataFrame([], "churn string")
    assert shown(kpi.domain_kpis(empty, "churn", [], ["churn"]))["Customer Churn Rate"] == "0.0%"


def test_generic(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert shown(kpi.domain_kpis(df, "Operations Performance", ["v"], quality_score=97)) == {
        "Total Row Count": "2", "Average Value": "1.50", "Data Integrity Score": "97/100",
    }


def test_specs(spark):
    df = spark.createDataFrame([("Yes", 1.0), ("No", 2.0), ("Yes", None)], "Attrition string, Amount double")
    specs = [
        KpiSpec("a", "Amount", "SUM"), KpiSpec("b", "Amount", "AVERAGE"), KpiSpec("c", "Amount", "RATIO"),
        KpiSpec("d", "Attrition", "COUNT"), KpiSpec("e", "Amount", "COUNT"), KpiSpec("f", "gone", "SUM"),
        KpiSpec("g", "Attrition", "SUM"),
    ]
    assert shown(kpi.evaluate_kpis(df, specs)) == {
        "a": "$3.00", "b": "$1.50", "c": "1.50", "d": "2", "e": "3", "f": "N/A", "g": "N/A",
    }
    none_left = df.where("Attrition = 'No'")
    assert shown(kpi.evaluate_kpis(none_left, [specs[3]])) == {"d": "1"}


def test_default_specs():
    hr = kpi.default_kpi_specs(["Employee_ID", "MonthlyIncome", "Attrition", "Tenure"], "HR")
    assert [s.column for s in hr] == ["Employee_ID", "MonthlyIncome", "Attrition"]
    other = kpi.default_kpi_specs(["a", "b"], "Anything")
    assert [(s.column, s.formula) for s in other] == [("b", "SUM"), ("b", "AVERAGE"), ("a", "COUNT")]


def test_scorecard(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    card = kpi.kpi_scorecard(kpi.evaluate_kpis(df, [KpiSpec("t", "gone", "SUM", "d")])).first()
    assert tuple(card) == (0, "t", "N/A", "d")


def test_segment_insights(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1500.0), (None, 9e9)], "s string, v double")
    first, second = insights.segment_insights(df, "s", "v").orderBy("pos").collect()
    assert first["finding"] == "The segment 'b' displays the highest metric average at 1,500.00."
    assert "all 3 records" in second["finding"]
    nothing = insights.segment_insights(df.limit(0), "s", "v").orderBy("pos").first()
    assert nothing["finding"] == "The segment 'Primary Segment' displays the highest metric average at N/A."


@pytest.mark.parametrize("n, expected", [(0, 0), (3, 3), (6, 5)])
def test_chart_insights(spark, n, expected):
    charts = [Chart(f"c{i}", "pie", "s", None, f"title {i}", "primary") for i in range(n)]
    found = insights.chart_insights(spark.range(7), charts).collect()
    assert len(found) == expected
    if found:
        assert found[0]["evidence"] == "Analyzed 7 records across s and distribution."
