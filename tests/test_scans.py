"""How often operators read their table, and what the one write of an analysis carries."""

import datetime
import random
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions.kpi_tables import KpiSpec
from tabwise.operators import charts, clean, kpi, profile, roles, rules, timeseries
from tabwise.operators.quantiles import exact_medians
from tabwise.plans import analysis
from tabwise.sources.sinks import write_measured


@pytest.fixture()
def counted(spark):
    """(frame, reads): a frame whose rows count themselves when they are read."""

    def make(df):
        reads = spark.sparkContext.accumulator(0)

        def run(batches):
            for batch in batches:
                reads.add(len(batch))
                yield batch

        rows = df.count()
        return df.mapInArrow(run, df.schema), lambda: reads.value / rows

    return make


def test_medians_take_two_scans(spark, counted):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) * 10 ** rng.randrange(-20, 20) for _ in range(30_001)]
    df, reads = counted(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int").repartition(4))
    assert exact_medians(df, ["v", "i"]) == {"v": statistics.median(values), "i": 15_000.0}
    assert reads() == 2


def test_a_bracket_that_misses_is_searched_again(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    from tabwise.operators.quantiles import Spread

    for wrong in ((1.0, 2.0), (900.0, 950.0), (2000.0, 3000.0)):
        assert exact_medians(df, ["v"], {"v": Spread(1000, 1.0, 1000.0, wrong)}) == {"v": 500.5}


def test_violations_take_two_scans(spark, counted):
    rows = [(float(i % 10), -1.0 if i % 50 == 0 else 1.0) for i in range(500)] + [(1e6, 1.0)]
    df, reads = counted(spark.createDataFrame(rows, "amount double, price double"))
    found = {(r["column"], r["severity"]): r["n_rows"] for r in rules.violations(df, ["amount", "price"], ["amount", "price"]).collect()}
    assert found == {("price", "WARNING"): 10, ("amount", "INFO"): 1, ("price", "INFO"): 10}
    assert reads() == 2


def test_correlations_take_two_scans(spark, counted):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(400, 30)) @ rng.normal(size=(30, 30)) + 1e5
    values[rng.random(values.shape) < 0.1] = np.nan
    rows = [tuple(None if np.isnan(x) else float(x) for x in row) for row in values]
    df, reads = counted(spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(30))).repartition(3))
    found = {(r["col_a"], r["col_b"]): r["r"] for r in charts.correlation_matrix(df, df.columns).collect()}
    assert reads() == 2 and len(found) == 900
    for i in range(30):
        for j in range(30):
            both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            assert found[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(values[both, i], values[both, j])[0, 1], abs=1e-9)


def test_a_pair_constant_on_its_common_rows(spark):
    rows = [(0.1, 1.0 + i) for i in range(5)] + [(float(i), None) for i in range(7)]
    found = {(r["col_a"], r["col_b"]): r["r"] for r in charts.correlation_matrix(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    assert found == {("a", "a"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 1.0}


def test_ranges_of_columns_come_from_the_tasks(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, nan, None, inf), (None, 5.0, None, -inf), (-3.0, nan, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(2)
    found = {r["a"]: (r["rows"], r["n"], r["low"], r["high"]) for r in charts._ranges(df).collect()}
    assert found == {0: (3, 2, -3.0, 1.0), 1: (3, 1, 5.0, 5.0), 3: (3, 3, -inf, inf)}
    assert charts._ranges(df.limit(0)).count() == 0


def test_wide_correlations_run_in_short_methods(spark, monkeypatch):
    """Both scans are read while long generated methods are off; the setting comes back."""
    setting, seen = "spark.sql.codegen.hugeMethodLimit", []
    before, collect = spark.conf.get(setting), type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: (seen.append(spark.conf.get(setting)), collect(self))[1])
    df = spark.range(50).select(*[(F.col("id") * i % 7).alias(f"c{i}") for i in range(1, 20)])
    charts.correlation_matrix(df, df.columns)
    assert seen == ["8000", "8000"] and spark.conf.get(setting) == before


def plain_steps(rows):
    days = [(b - a) // datetime.timedelta(days=1) for a, b in zip(rows, rows[1:])]
    modal = min(set(days), key=lambda d: (-days.count(d), d)) if days else None
    return modal, all(a <= b for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_steps_equal_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(5) if seed else i, f"k{rng.randrange(3)}", start + datetime.timedelta(hours=rng.choice([0, 12, 24 * i, 24 * i + 7]))) for i in range(300)]
    rows += [rows[7]] * 50
    df = spark.createDataFrame([*rows, (1, "x", None)], "a int, b string, d timestamp").repartition(5)
    ordered = [d for *_, d in sorted(rows)]
    got = timeseries.time_series_structure(df, "d", ["a", "b"]).first()
    assert (got["modal_step"], got["is_chronologically_sorted"]) == plain_steps(ordered)
    by_date = timeseries.time_series_structure(df, "d").first()
    assert by_date["modal_step"] == plain_steps(sorted(ordered))[0]
    assert by_date["is_chronologically_sorted"] is None
    assert (got["min_date"], got["max_date"]) == (by_date["min_date"], by_date["max_date"]) == (str(min(ordered).date()), str(max(ordered).date()))


def test_steps_of_few_rows(spark):
    df = spark.createDataFrame([(1, datetime.date(2024, 5, 1))], "k int, d date")
    for frame in (df, df.limit(0)):
        assert timeseries.time_series_structure(frame, "d").count() == 0
        assert timeseries.time_series_structure(frame, "d", ["k"]).count() == 0
    two = spark.createDataFrame([(1, datetime.date(2024, 5, 1)), (2, datetime.date(2024, 5, 8))], "k int, d date")
    assert timeseries.time_series_structure(two, "d").first()["estimated_frequency"] == "Weekly"


def test_one_range_exchange(spark):
    df = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 86400).alias("t"))
    plan = timeseries._steps_in_date_order(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()


def test_a_write_carries_its_metrics(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("v")).dropDuplicates()
    seen = write_measured(df, str(tmp_path / "t"), {"rows": F.count("*"), "gaps": F.count_if(F.col("v").isNull()), "mean": F.avg("v")})
    assert seen["rows"] == spark.read.parquet(str(tmp_path / "t")).count()
    assert seen["gaps"] == df.where("v is null").count()
    empty = write_measured(df.limit(0).dropDuplicates(), str(tmp_path / "e"), {"rows": F.count("*"), "mean": F.avg("v")})
    assert empty == {"rows": 0, "mean": None}


def dirty(spark):
    rows = [(i, f" c{i % 3} ", None if i % 7 == 0 else float(i % 40) * (-1 if i % 50 == 1 else 1), f"2024-0{1 + i % 9}-11") for i in range(300)]
    return spark.createDataFrame(rows + rows[:20], "sale_id int, region string, amount double, day string").repartition(3)


def test_an_analysis_writes_the_cleaned_table_once(spark, tmp_path, counted):
    df = dirty(spark)
    found = analysis.discover(df)
    frame, reads = counted(df)
    results = analysis.execute(frame, found, folder=str(tmp_path))
    assert reads() == 2  # the values to impute from, and the write
    cleaned = results.cleaned.collect()
    assert len(cleaned) == 300 and results.reconciliation.first()["after_rows"] == 300
    assert {r["column"]: r["nulls"] for r in results.gaps.collect()} == {c: sum(r[c] is None for r in cleaned) for c in results.cleaned.columns}
    middle = statistics.median(r[2] for r in df.distinct().collect() if r[2] is not None)
    assert sum(r["amount"] == middle for r in cleaned) >= 42
    plain = rules.violations(results.cleaned, rules.non_negative_columns(found.columns), rules.list_numeric(found.columns))
    assert sorted(map(tuple, results.violations.collect())) == sorted(map(tuple, plain.collect()))
    again = kpi.domain_kpis(results.cleaned, found.domain, found.names_with_role("Numerical"), found.names_with_role("Boolean", "Categorical"), found.summary.first()["quality_score"])
    assert list(map(tuple, results.kpis.orderBy("pos").collect())) == list(map(tuple, again.orderBy("pos").collect()))
    assert results.segments.count() == 2 and results.left_out.count() == 0
    paths = results.write(str(tmp_path))
    assert spark.read.parquet(paths["cleaned_data"]).count() == 300
    other = results.write(str(tmp_path / "csv"), "csv")
    assert spark.read.csv(other["cleaned_data"], header=True).count() == 300


def test_what_an_analysis_leaves_out(spark):
    df = dirty(spark)
    found = analysis.discover(df)
    asked = [("day", "amount"), ("region", "amount"), ("sale_id", "amount"), ("gone", None), ("region", "amount"), ("region", None)]
    results = analysis.execute(df, found, asked, max_charts=2, limits=charts.Limits(categories=1))
    assert [tuple(r) for r in results.left_out.collect()] == [
        (2, "sale_id", "amount", charts.IDENTIFIER), (3, "gone", None, charts.NO_COLUMN),
        (4, "region", "amount", charts.ASKED_BEFORE), (5, "region", None, charts.BEYOND_LIMIT),
    ]
    drawn = results.charts.groupBy("chart_type", "title").count().collect()
    assert {(r["chart_type"], r["title"], r["count"]) for r in drawn} == {("line", "amount by day", 9), ("bar", "amount by region", 1)}


def test_an_empty_table(spark):
    df = dirty(spark).limit(0)
    results = analysis.execute(df, analysis.discover(df))
    assert results.cleaned.count() == 0 and results.reconciliation.first()["after_rows"] == 0


def test_sums_in_their_own_type(spark):
    schema = "label string, cents decimal(20,2), big bigint, small int, ratio double, flag boolean"
    rows = [("a", Decimal("999999999999999999.01"), 2**62, 5, 0.1, True)] * 1000
    df = spark.createDataFrame(rows, schema)
    total = {c: charts.top_categories(df, "label", c).first()["value"] for c in ("cents", "big", "small", "ratio")}
    assert total == {"cents": Decimal("999999999999999999010.00"), "big": 2**62 * 1000, "small": 5000, "ratio": pytest.approx(100.0, abs=1e-12)}
    specs = [KpiSpec(c, c, "SUM") for c in ("cents", "big", "flag")] + [KpiSpec("mean", "small", "AVERAGE")]
    shown = {r["title"]: r["display"] for r in kpi.evaluate_kpis(df, specs).collect()}
    assert shown == {"cents": "$999,999,999,999,999,999,010.00", "big": f"${2**62 * 1000:,}.00", "flag": "$1,000.00", "mean": "$5.00"}


def test_sums_of_doubles_keep_cents(spark):
    values = [0.01 * (i % 997) + (1e9 if i % 100 == 0 else 0) for i in range(50_000)]
    df = spark.createDataFrame([("a", v) for v in values], "label string, v double").repartition(7)
    import math

    assert charts.top_categories(df, "label", "v").first()["value"] == pytest.approx(math.fsum(values), rel=1e-15)
    extreme = spark.createDataFrame([("a", 1e300), ("a", 1e300), ("b", float("inf")), ("c", None)], "label string, v double")
    assert {r["label"]: r["value"] for r in charts.top_categories(extreme, "label", "v").collect()} == {"a": 2e300, "b": math.inf, "c": 0.0}


def test_sampled_date_likeness_looks_at_different_values(spark):
    rows = [("2024-01-02", "x" * 10_000)] * 900 + [(f"2024-01-{k:02}", f"w{k}") for k in range(1, 29)] + [("junk", None)] * 900
    df = spark.createDataFrame(rows, "d string, t string")
    found = {r["column"]: r["date_like_ratio"] for r in profile.date_likeness(df, sample=10).collect()}
    assert found["d"] >= 0.8 and found["t"] == 0.0
    assert {r["date_like_ratio"] for r in profile.date_likeness(df.limit(0), sample=3).collect()} == {0.0}


def test_domain_reads_no_rows(spark, counted):
    df, reads = counted(spark.createDataFrame([(1, 2.0)], "k int, Amount double"))
    assert roles.detect_domain(roles.schema_columns(df)).first()["domain"] == "Sales & Revenue"
    assert reads() == 0


def test_whole_numbers_with_gaps_from_text_are_no_identifiers(spark, tmp_path):
    lines = ["order_id,Year,day,v", *[f"{i if i % 9 else ''},2024,2024-01-{1 + i % 28:02},{i}" for i in range(1, 120)]]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    df = analysis.ingest(spark, str(tmp_path / "t.csv"))
    found = analysis.discover(df)
    assert {r["column"]: r["role"] for r in found.columns.collect()}["order_id"] == "Numerical"
    assert found.time_series.first()["date_column"] == "day"
    plain = df.select(*[F.col(c).alias(c, metadata={}) for c in df.columns])
    assert isinstance(plain.schema["order_id"].dataType, T.LongType)
    typed = analysis.discover(plain, nullable_ints_are_floats=False)
    assert {r["column"]: r["role"] for r in typed.columns.collect()}["order_id"] == "Identifier"


def test_medians_of_distinct_rows(spark):
    df = spark.createDataFrame([(1, 1.0)] * 9 + [(2, 5.0), (3, 7.0), (4, None)], "digest int, v double")
    assert clean.distinct_row_medians(df, ["v"]) == {"v": 5.0}


def test_frequent_values_count_only_the_leaders(spark, counted, monkeypatch):
    rows = [(f"hot{i % 4}" if i % 2 else f"rare{i}",) for i in range(20_000)]
    df, reads = counted(spark.createDataFrame([*rows, (None,)], "s string").repartition(4))
    full = []
    monkeypatch.setattr(charts, "value_counts", lambda *a: full.append(a) or df.limit(0))
    got = [tuple(r) for r in charts.frequent_values(df, "s", 2, tracked=1000).collect()]
    assert got == [("hot1", 5000), ("hot3", 5000)] and not full
    assert reads() == 2
    charts.frequent_values(df, "s", 3, tracked=1000)  # the third is as rare as all others
    assert len(full) == 1


@pytest.mark.parametrize("seed", range(3))
def test_frequent_values_equal_exact_counts(spark, seed):
    rng = random.Random(seed)
    rows = [(f"v{int(rng.paretovariate(0.6))}",) for _ in range(5000)]
    df = spark.createDataFrame(rows, "s string").repartition(3)
    for tracked in (16, 200, 5000):
        got = sorted(map(tuple, charts.frequent_values(df, "s", 5, tracked).collect()))
        assert got == sorted(map(tuple, charts.value_counts(df, "s", 5).collect()))


def test_stored_sketches_merge(spark, tmp_path):
    from tabwise.operators import sketches

    days = [spark.range(k * 4000, k * 4000 + 6000).select(F.col("id"), F.when(F.col("id") % 2 > 0, F.col("id") % 10).alias("few"), F.array("id").alias("nested")) for k in range(3)]
    path = str(tmp_path / "s")
    for k, day in enumerate([*days, days[0]]):  # the first is loaded twice
        sketches.append_sketches(sketches.column_sketches(day, f"day{k % 3}"), path)
    found = {r["column"]: r for r in sketches.merged_counts(sketches.read_sketches(spark, path)).collect()}
    assert set(found) == {"id", "few"} and found["id"]["rows"] == 18_000 and found["few"]["nulls"] == 9_000
    assert found["few"]["distinct"] == 5 and abs(found["id"]["distinct"] - 14_000) < 0.08 * 14_000
    parts = days[0].withColumn("p", F.col("id") % 3)
    by_part = sketches.column_sketches(parts, F.col("p"))
    assert by_part.select("part").distinct().count() == 3
    assert sketches.column_sketches(days[0].limit(0)).count() == 0
