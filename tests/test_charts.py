import datetime
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.operators import charts
from tabwise.operators.profile import column_profile
from tabwise.operators.roles import assign_roles


def roled(df):
    return assign_roles(column_profile(df))


def pairs(df):
    return [(r["label"], r["value"]) for r in df.collect()]


def test_monthly_trend(spark):
    df = spark.createDataFrame(
        [("2025-01-05", 1.0), ("2025/1/31", 2.0), ("2025-03-01", None), ("junk", 9.0), (None, 9.0)],
        "d string, v double",
    )
    assert pairs(charts.monthly_trend(df, "d", "v")) == [("2025-01", 3.0), ("2025-03", 0.0)]


def test_monthly_sums_add_up(spark):
    df = spark.range(1000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
        F.col("id").cast("double").alias("v"),
    )
    assert sum(v for _, v in pairs(charts.monthly_trend(df, "d", "v"))) == 999 * 1000 / 2


def test_top_bottom_and_ties(spark):
    data = [("b", 5.0), ("a", 5.0), ("c", 7.0), (None, 99.0), ("d", None)]
    df = spark.createDataFrame(data, "s string, v double")
    assert pairs(charts.top_categories(df, "s", "v", 3)) == [("c", 7.0), ("a", 5.0), ("b", 5.0)]
    assert pairs(charts.bottom_categories(df, "s", "v", 2)) == [("d", 0.0), ("a", 5.0)]


def test_counts_and_share(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbcdefg"] + [(None,)] * 5, "s string")
    assert pairs(charts.value_counts(df, "s")) == [("a", 3), ("b", 2), ("c", 1), ("d", 1), ("e", 1), ("f", 1)]
    assert [r["share"] for r in charts.value_share(df, "s").collect()] == [33.3, 22.2, 11.1, 11.1, 11.1, 11.1]


def test_scatter(spark):
    df = spark.range(500).select(
        F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("x"), (F.col("id") * 2).alias("y")
    )
    points = charts.scatter_points(df, "x", "y", ["k"]).collect()
    assert len(points) == 150
    assert [(p["pos"], p["label"], p["x"], p["y"]) for p in points[:2]] == [
        (0, "Rec 0", 0.0, 0.0), (1, "Rec 1", 2.0, 4.0),
    ]
    spread = charts.scatter_points(df, "x", "y", ["k"], sample_by="hash").collect()
    assert len(spread) == 150 and max(p["x"] for p in spread) > 400
    assert charts.scatter_points(df, "x", "y", limit=None).count() == 250
    with pytest.raises(ValueError):
        charts.scatter_points(df, "x", "y", sample_by="other")


def matrix(df, columns):
    return {(r["col_a"], r["col_b"]): r["r"] for r in charts.correlation_matrix(df, columns).collect()}


def test_correlation_with_gaps_and_constants(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None), (2.0, None, 5.0, None), (3.0, 6.0, 5.0, None)],
        "a double, b double, c double, none double",
    )
    found = matrix(df, ["a", "b", "c", "none"])
    assert len(found) == 16
    assert found["a", "b"] == pytest.approx(1.0) and found["b", "a"] == found["a", "b"]
    assert found["a", "c"] == found["c", "c"] == found["none", "none"] == found["a", "none"] == 0.0
    assert found["a", "a"] == 1.0


def test_correlation_matches_numpy_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(charts, "PAIRS_PER_PASS", 4)
    values = np.random.default_rng(3).normal(size=(200, 4)) + 1e6
    names = ["n a", "n.b", "nc", "nd"]
    df = spark.createDataFrame([tuple(map(float, v)) for v in values], names)
    expected = np.corrcoef(values.T)
    found = matrix(df, names)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert found[a, b] == pytest.approx(expected[i, j], abs=1e-8)


def test_segment_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None), (None, 7.0)], "s string, v double")
    assert pairs(charts.segment_means(df, "s", "v")) == [("b", 5.0), ("a", 2.0), ("c", None)]


@pytest.fixture(scope="module")
def sales(spark):
    start = datetime.date(2025, 1, 1)
    data = [
        (
            i,
            start + datetime.timedelta(days=i % 200),
            f"c{0 if i % 3 == 0 else i % 40}",
            ["x", "y"][i % 2],
            float(i % 13),
            float(i % 7),
        )
        for i in range(900)
    ]
    return spark.createDataFrame(
        data, "sale_id int, date date, city string, channel string, amount double, units double"
    ).repartition(6)


ASKED = [
    ("date", "amount"), ("city", "amount"), ("channel", "amount"), ("city", None), ("channel", None),
    ("sale_id", "amount"), ("amount", "units"), ("gone", "amount"), ("channel", "amount"), (None, None),
]


def test_chart_choice(sales):
    planned = charts.plan_charts(roled(sales), ASKED)
    assert [(c.chart_type, c.x, c.y, c.slot) for c in planned] == [
        ("line", "date", "amount", "primary"),
        ("horizontalBar", "city", "amount", "primary"),
        ("bar", "channel", "amount", "primary"),
        ("horizontalBar", "city", None, "primary"),
        ("pie", "channel", None, "supporting"),
        ("scatter", "amount", "units", "supporting"),
    ]
    assert planned[0].chart_id == "chart_date_amount_line"


def test_asked_type_stands_where_no_rule_applies(sales):
    df = sales.withColumn("memo", F.concat(F.lit("some long text for memo "), F.col("sale_id")))
    planned = charts.plan_charts(roled(df), [("memo", "amount", "bar")])
    assert planned[0].chart_type == "bar"


def test_batch_matches_brute_force(sales):
    planned = charts.plan_charts(roled(sales), [*ASKED[:5], (None, None)])
    batch = charts.chart_batch(sales, planned, ["amount", "units"], ["sale_id"]).collect()
    by_chart = defaultdict(list)
    for r in sorted(batch, key=lambda r: r["pos"]):
        by_chart[r["chart_id"]].append((r["label"], r["value"]))
    data = sales.collect()

    def totals(key, value):
        found = defaultdict(float)
        for r in data:
            found[key(r)] += value(r)
        return found

    months = totals(lambda r: str(r["date"])[:7], lambda r: r["amount"])
    assert by_chart["chart_date_amount_line"] == sorted(months.items())
    cities = totals(lambda r: r["city"], lambda r: r["amount"])
    ranked = sorted(cities.items(), key=lambda kv: (-kv[1], kv[0]))
    assert by_chart["chart_city_amount_horizontalBar"] == ranked[:10]
    counts = totals(lambda r: r["city"], lambda r: 1.0)
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    assert by_chart["chart_city_None_horizontalBar"] == ranked[:6]
    assert len(by_chart["chart_channel_None_pie"]) == 2
    assert len(by_chart["chart_None_None_heatmap"]) == 4


def test_batch_of_nothing(sales):
    assert charts.chart_batch(sales, []).count() == 0


def test_line_keeps_every_month(spark):
    df = spark.range(600).select(
        F.add_months(F.lit("1980-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.col("id").cast("double").alias("v"),
    )
    planned = charts.plan_charts(roled(df), [("date", "v")])
    batch = charts.chart_batch(df, planned)
    assert batch.count() == 600 and batch.agg(F.max("pos")).first()[0] == 599


def test_grouped_charts_share_one_scan(sales):
    planned = charts.plan_charts(roled(sales), ASKED[:5])
    plan = charts.chart_batch(sales, planned)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
    assert "WindowGroupLimit" in plan
