"""Named queries over the test tables, one or more per operator.

Every query reads whole tables.  Doubles are rounded here, at the edge, so that
the order of additions cannot show in a comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.kpi_tables import KpiSpec
from tabwise.functions.staging import scratch_path
from tabwise.operators import charts, clean, governance, insights, kpi, profile, roles, rules, sketches
from tabwise.operators.timeseries import time_series_structure
from tabwise.plans import analysis
from tabwise.sources import run_log, sinks
from tabwise.sources.readers import csv_rejects as read_rejects
from tabwise.sources.readers import read_table
from tabwise.streaming.run_log import follow_log

Query = Callable[[SparkSession, str], DataFrame]

ROLE_TABLES = ("orders", "lineitem", "events", "customer", "documents", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with planted gaps, negatives, padding, bad dates and repeats.

    The test tables are clean; this view gives the cleaning operators work.
    All rows of the table are in it.
    """
    key = F.col("o_orderkey")
    priority = F.col("o_orderpriority")
    price = F.col("o_totalprice")
    return (
        table(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            F.when(key % 37 == 0, None).when(key % 101 == 0, -price).otherwise(price).alias(
                "o_totalprice"
            ),
            F.when(key % 53 == 0, "not a date")
            .when(key % 59 == 0, None)
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
            .alias("o_orderdate"),
            F.when(key % 41 == 0, None)
            .when(key % 7 == 0, F.concat(F.lit("  "), priority, F.lit(" ")))
            .otherwise(priority)
            .alias("o_orderpriority"),
            F.explode(F.sequence(F.lit(1), F.when(key % 50 == 0, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def roled(df: DataFrame, exact: bool = True) -> DataFrame:
    return roles.assign_roles(profile.column_profile(df, exact, median=False))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- profile -----------------------------------------------------------------


def table_shape(spark, sf):
    return profile.table_shape(dirty_orders(spark, sf))


def table_summary(spark, sf):
    return profile.table_summary(dirty_orders(spark, sf))


def null_counts(spark, sf):
    return profile.null_counts(dirty_orders(spark, sf))


def duplicate_count(spark, sf):
    return profile.duplicate_count(dirty_orders(spark, sf))


def quality_score(spark, sf):
    return profile.quality_score(dirty_orders(spark, sf))


def distinct_counts(spark, sf):
    return profile.distinct_counts(table(spark, sf, "lineitem"))


def distinct_counts_text(spark, sf):
    return profile.distinct_counts(table(spark, sf, "documents"))


def numeric_summary(spark, sf):
    found = profile.numeric_summary(table(spark, sf, "lineitem"))
    return rounded(found, 6, "mean", "min_num", "max_num", "median")


def string_lengths(spark, sf):
    return rounded(profile.string_lengths(table(spark, sf, "documents")), 6, "avg_len")


def date_likeness(spark, sf):
    return rounded(profile.date_likeness(dirty_orders(spark, sf)), 6, "date_like_ratio")


def date_likeness_sampled(spark, sf):
    return rounded(profile.date_likeness(dirty_orders(spark, sf), sample=10), 6, "date_like_ratio")


def duplicate_count_nan(spark, sf):
    """Copies that differ only in NaN and NULL are duplicates."""
    copies = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    gap = F.when(F.col("copy") == 0, float("nan"))
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", copies)
    df = df.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, gap).otherwise(F.col("o_totalprice")))
    return profile.duplicate_count(df.drop("copy"))


def numeric_summary_extreme(spark, sf):
    """Medians over many magnitudes, neighbouring doubles, denormals and huge values."""
    key = F.col("o_orderkey")
    power = F.concat(F.lit("1e"), (key % 61 - 30).cast("string")).cast("double")
    df = table(spark, sf, "orders").select(
        F.when(key % 2 == 0, power).otherwise(-power).alias("magnitudes"),
        F.when(key % 100 == 0, F.lit(1e300)).otherwise(1.0 + (key % 9) * F.lit(2.0**-52)).alias("neighbours"),
        ((key % 5) * F.lit(5e-324)).alias("denormals"),
        (F.lit(1e308) + (key % 7) * F.lit(1e307)).alias("huge"),
    )
    return profile.numeric_summary(df).select("column", "min_num", "max_num", "median")


def column_profile(spark, sf):
    found = profile.column_profile(dirty_orders(spark, sf))
    digits = ("unique_ratio", "mean", "min_num", "max_num", "median", "avg_len", "date_like_ratio")
    return rounded(found, 6, *digits)


def time_series_structure_by_key(spark, sf):
    return time_series_structure(table(spark, sf, "orders"), "o_orderdate", ["o_orderkey"])


def time_series_structure_by_date(spark, sf):
    return time_series_structure(table(spark, sf, "events"), "ts")


def derived_unit_price(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
    )
    ratios = {"unit_price": ("l_extendedprice", "l_quantity")}
    return profile.derived_metrics(df, ratios)


def derived_totals(spark, sf):
    ratios = {"unit_price": ("l_extendedprice", "l_quantity"), "tax_share": ("l_tax", "l_discount")}
    found = profile.derived_totals(table(spark, sf, "lineitem"), ratios)
    return rounded(found, 4, "numerator", "denominator", "value")


def derived_suggestions(spark, sf):
    df = table(spark, sf, "lineitem").withColumnRenamed("l_quantity", "Quantity")
    return profile.derived_suggestions(roled(df))


# --- roles -------------------------------------------------------------------


def _roles_of(name: str, exact: bool = True) -> Query:
    def query(spark, sf):
        return roled(table(spark, sf, name), exact).select("column", "kind", "distinct", "role")

    return query


def column_roles_fast(spark, sf):
    return roled(table(spark, sf, "lineitem"), exact=False).select("column", "kind", "role")


def column_roles_stored(spark, sf):
    """Roles from sketches stored by month of shipping, counts near a border taken again."""
    df, path = table(spark, sf, "lineitem"), scratch_path(spark, "sketches")
    sketches.append_sketches(sketches.column_sketches(df, F.date_format("l_shipdate", "yyyy-MM")), path)
    counts = sketches.merged_counts(sketches.read_sketches(spark, path))
    found = profile.column_profile(df, exact=False, median=False, counts=counts)
    return roles.assign_roles(found).select("column", "kind", "role")


def role_tags(spark, sf):
    return roled(table(spark, sf, "lineitem")).select(
        "column", "is_date", "is_numeric", "is_categorical", "is_primary_key", "is_foreign_key",
        "is_currency", "is_percentage", "is_geo", "is_target",
    )


def percentage_fields(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("discount_rate"),
        (F.col("l_tax") * 100).alias("tax_pct"),
        F.col("l_quantity").alias("quantity_share"),
        F.col("l_extendedprice").alias("price_ratio"),
    )
    return roled(df).where("is_percentage").select("column")


def bi_mapping(spark, sf):
    return roles.bi_mapping(roled(table(spark, sf, "orders")))


def relationships(spark, sf):
    return roles.relationships(roled(table(spark, sf, "lineitem")))


def domain(spark, sf):
    parts = [
        roles.detect_domain(roles.schema_columns(table(spark, sf, t)), mode).select(
            F.lit(t).alias("table_name"), F.lit(mode).alias("mode"), "domain"
        )
        for t in ("orders", "customer", "events")
        for mode in ("substring", "exact")
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def chart_candidates(spark, sf):
    return roles.chart_candidates(roled(table(spark, sf, "orders")))


# --- cleaning ----------------------------------------------------------------


def drop_duplicates(spark, sf):
    return clean.drop_duplicates(dirty_orders(spark, sf))


def impute_median(spark, sf):
    return rounded(clean.impute_median(dirty_orders(spark, sf), ["o_totalprice"]), 4, "o_totalprice")


def fill_unknown(spark, sf):
    return clean.fill_unknown(dirty_orders(spark, sf), ["o_orderdate", "o_orderpriority"])


def trim_text(spark, sf):
    return clean.trim_text(dirty_orders(spark, sf), ["o_orderstatus", "o_orderpriority"])


def standardize_dates(spark, sf):
    return clean.standardize_dates(dirty_orders(spark, sf), ["o_orderdate"])


def mixed_dates(spark, sf):
    """Order dates written in several shapes, one of them invalid."""
    date = F.col("o_orderdate")
    turn = F.col("o_orderkey") % 6
    text = (
        F.when(turn == 0, F.date_format(date, "yyyy-MM-dd"))
        .when(turn == 1, F.date_format(date, "yyyy/M/d"))
        .when(turn == 2, F.date_format(date, "MM/dd/yyyy"))
        .when(turn == 3, F.date_format(date, "M-d-yyyy"))
        .when(turn == 4, F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.year(date).cast("string"), F.lit("-02-30")))
    )
    df = table(spark, sf, "orders").select("o_orderkey", text.alias("o_orderdate"))
    return clean.standardize_dates(df, ["o_orderdate"])


def clean_table(spark, sf):
    df = dirty_orders(spark, sf)
    return rounded(clean.clean(df, roled(df)), 4, "o_totalprice")


def clean_reconciliation(spark, sf):
    df = dirty_orders(spark, sf)
    return rounded(clean.reconcile(df, clean.drop_duplicates(df)), 6, "retention_pct")


# --- rules -------------------------------------------------------------------


def negative_rule(spark, sf):
    return rules.negative_rule(dirty_orders(spark, sf), ["o_totalprice", "o_custkey"])


def negative_rule_balances(spark, sf):
    return rules.negative_rule(table(spark, sf, "customer"), ["c_acctbal"]).unionByName(
        rules.negative_rule(table(spark, sf, "supplier"), ["s_acctbal"])
    )


def outlier_rule(spark, sf):
    return rules.outlier_rule(table(spark, sf, "events"), ["value", "user_id"]).unionByName(
        rules.outlier_rule(table(spark, sf, "documents"), ["n_chars"])
    )


def outlier_rule_inf(spark, sf):
    """A column with infinite values has no outliers; others are judged as ever."""
    df = table(spark, sf, "events").withColumn(
        "spiked", F.when(F.col("event_id") % 1000 == 0, float("inf")).otherwise(F.col("value"))
    )
    return rules.violations(df, ["value", "spiked"], ["value", "spiked", "user_id"])


def outlier_rows(spark, sf):
    found = rules.outlier_rows(table(spark, sf, "events"), ["value"], keep=["event_id", "event_type"])
    return rounded(found, 6, "z")


def _violations(spark, sf) -> DataFrame:
    df = dirty_orders(spark, sf)
    found = roled(df)
    return rules.violations(df, rules.non_negative_columns(found), rules.list_numeric(found))


def violations(spark, sf):
    return _violations(spark, sf)


def violation_report(spark, sf):
    return rules.violation_report(_violations(spark, sf))


def governance_score(spark, sf):
    return governance.governance_score(rules.violation_report(_violations(spark, sf)))


def live_certificate(spark, sf):
    return governance.live_certificate(profile.table_summary(dirty_orders(spark, sf)))


def governance_audit(spark, sf):
    df = dirty_orders(spark, sf)
    report = rules.violation_report(analysis.kept(_violations(spark, sf)))
    return governance.governance_audit(
        analysis.kept(clean.reconcile(df, clean.drop_duplicates(df))),
        report,
        governance.governance_score(report),
    )


# --- charts ------------------------------------------------------------------


def monthly_trend(spark, sf):
    found = charts.monthly_trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(found, 2, "value")


def monthly_trend_lineitem(spark, sf):
    found = charts.monthly_trend(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice")
    return rounded(found, 2, "value")


def top_categories(spark, sf):
    found = charts.top_categories(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice")
    return rounded(found, 2, "value")


def top_priorities(spark, sf):
    found = charts.top_categories(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(found, 2, "value")


def _big_money(spark, sf) -> DataFrame:
    """Line items with prices of up to 18 digits and cents, more than a double holds."""
    price = (F.col("l_extendedprice").cast("decimal(15,2)") * 1_000_000_000 + F.lit("0.01").cast("decimal(3,2)")).cast("decimal(28,2)")
    return table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_returnflag", "l_tax", price.alias("price"))


def top_categories_decimal(spark, sf):
    found = charts.top_categories(_big_money(spark, sf), "l_suppkey", "price")
    return found.select("label", F.col("value").cast("decimal(38,2)").cast("string").alias("value"))


def bottom_categories(spark, sf):
    found = charts.bottom_categories(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice")
    return rounded(found, 2, "value")


def value_counts(spark, sf):
    return charts.value_counts(table(spark, sf, "events"), "event_type")


def frequent_values_even(spark, sf):
    """Labels so even that no sketch can tell the leaders: all are counted."""
    return charts.frequent_values(table(spark, sf, "lineitem"), "l_partkey")


def frequent_values_skewed(spark, sf):
    """Very many labels, a few of them frequent: only those are counted exactly."""
    key = F.col("l_orderkey")
    label = F.when(key % 3 == 0, F.concat(F.lit("s"), (key % 7).cast("string"))).otherwise(F.concat_ws("-", key, "l_linenumber", "l_partkey"))
    return charts.frequent_values(table(spark, sf, "lineitem").select(label.alias("label")), "label", 5)


def value_share(spark, sf):
    return charts.value_share(table(spark, sf, "events"), "event_type")


def scatter_points(spark, sf):
    return charts.scatter_points(
        table(spark, sf, "lineitem"),
        "l_quantity",
        "l_extendedprice",
        ["l_orderkey", "l_linenumber", "l_partkey"],
    )


def scatter_all_points(spark, sf):
    return charts.scatter_points(dirty_orders(spark, sf), "o_custkey", "o_totalprice", limit=None)


CORRELATED = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)


def correlation_matrix(spark, sf):
    found = charts.correlation_matrix(table(spark, sf, "lineitem"), CORRELATED)
    return rounded(found, 6, "r")


def correlation_with_nulls(spark, sf):
    found = charts.correlation_matrix(
        dirty_orders(spark, sf), ["o_orderkey", "o_custkey", "o_totalprice"]
    )
    return rounded(found, 6, "r")


def correlation_inf(spark, sf):
    """Infinite values leave a column without correlations."""
    df = table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice",
        F.when(F.col("l_orderkey") % 1000 == 1, float("inf")).otherwise(F.col("l_tax")).alias("l_tax"),
    )
    return rounded(charts.correlation_matrix(df, df.columns), 6, "r")


WIDE = 60


def correlation_wide(spark, sf):
    """Sixty columns, every second one with gaps of its own."""

    def mixed(i: int):
        value = F.col("l_quantity") * (i % 13) + F.col("l_extendedprice") / 100 * (i * 7 % 5) + F.col("l_partkey") * (i * 3 % 4) + F.col("l_linenumber") * (i + 1)
        gap = F.lit(i % 2 == 1) & ((F.col("l_orderkey") + i) % 11 == 0)
        return F.when(~gap, value.cast("double")).alias(f"c{i}")

    df = table(spark, sf, "lineitem").select(*[mixed(i) for i in range(WIDE)])
    return rounded(charts.correlation_matrix(df, df.columns), 6, "r")


ASKED_CHARTS: Sequence[tuple] = (
    ("o_orderdate", "o_totalprice", None, "How do sales develop?"),
    ("o_orderpriority", "o_totalprice", None, "Which priority sells most?"),
    ("o_orderstatus", None, None, "How are orders spread over states?"),
    ("o_orderkey", "o_totalprice", None, "An identifier is not drawn"),
    ("o_orderstatus", None, None, "Asked twice"),
    ("o_missing", "o_totalprice", None, "No such column"),
    ("o_custkey", "o_totalprice", None, "Do customers differ?"),
    (None, None, None, "What moves together?"),
)


def chart_left_out(spark, sf):
    return charts.left_out(roled(table(spark, sf, "orders")), ASKED_CHARTS, max_charts=4)


#: More pairs than a dashboard shows by default.
ALL_CHARTS: Sequence[tuple] = (
    ("o_orderdate", "o_totalprice", None, "Sales by month"),
    ("o_orderpriority", "o_totalprice", None, "Sales by priority"),
    ("o_orderstatus", None, None, "Orders by state"),
    ("o_orderpriority", None, None, "Orders by priority"),
    ("o_orderstatus", "o_totalprice", None, "Sales by state"),
    ("o_custkey", "o_totalprice", None, "Sales over customers"),
    ("o_orderdate", "o_custkey", None, "Customer numbers by month"),
    (None, None, None, "Correlations"),
)


def chart_batch_all(spark, sf):
    df = table(spark, sf, "orders")
    planned = charts.plan_charts(roled(df), ALL_CHARTS, max_charts=None)
    limits = charts.Limits(categories=3, counts=None, points=200)
    batch = charts.chart_batch(df, planned, ["o_custkey", "o_totalprice"], ["o_orderkey"], limits)
    return rounded(batch, 4, "value")


def chart_type_choice(spark, sf):
    return charts.chart_types(roled(table(spark, sf, "orders")), ASKED_CHARTS)


def _batch(spark, sf) -> DataFrame:
    df = table(spark, sf, "orders")
    planned = charts.plan_charts(roled(df), ASKED_CHARTS)
    batch = charts.chart_batch(df, planned, ["o_custkey", "o_totalprice"], ["o_orderkey"])
    return rounded(batch, 4, "value")


def chart_batch(spark, sf):
    return _batch(spark, sf).drop("title")


def chart_export(spark, sf):
    """The chart JSON, written and read back, one row per point."""
    path = scratch_path(spark, "charts")
    batch = _batch(spark, sf)
    sinks.write_chart_json(batch, path)
    point = "struct<pos:int,label:string,series:string,x:double,value:double>"
    schema = f"chart_id string, chart_type string, slot string, points array<{point}>"
    return (
        spark.read.schema(schema)
        .json(path)
        .select("chart_id", "chart_type", "slot", F.inline("points"))
    )


def segment_means(spark, sf):
    found = charts.segment_means(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(found, 4, "value")


def segment_insights(spark, sf):
    return insights.segment_insights(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


def chart_insights(spark, sf):
    df = table(spark, sf, "orders")
    return insights.chart_insights(df, charts.plan_charts(roled(df), ASKED_CHARTS))


# --- KPIs --------------------------------------------------------------------


def _domain_kpis(df: DataFrame, domain_label: str, score: int = 100) -> DataFrame:
    found = charts.column_roles(roled(df))
    by_role = {
        r: [c for c, f in found.items() if f.role == r]
        for r in ("Numerical", "Boolean", "Categorical")
    }
    return kpi.domain_kpis(
        df, domain_label, by_role["Numerical"], by_role["Boolean"] + by_role["Categorical"], score
    )


def kpi_sales(spark, sf):
    return rounded(_domain_kpis(table(spark, sf, "lineitem"), "Sales & Revenue"), 4, "value")


def kpi_rate_hr(spark, sf):
    df = table(spark, sf, "labels").select(
        "doc_id", F.col("toxic").alias("attrition"), (F.col("doc_id") * 3 % 1000).alias("base_pay")
    )
    return rounded(_domain_kpis(df, "Human Resources"), 4, "value")


def kpi_rate_churn(spark, sf):
    df = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "Churn").otherwise("stay").alias("churn_state"),
        F.col("value").alias("spend"),
    )
    return rounded(_domain_kpis(df, "Customer Churn"), 4, "value")


def kpi_generic(spark, sf):
    df = table(spark, sf, "events")
    score = profile.quality_score(df).first()["quality_score"]
    return rounded(_domain_kpis(df, "Operations Performance", score), 4, "value")


KPI_SPECS = (
    KpiSpec("Gross", "l_extendedprice", "SUM", "sum"),
    KpiSpec("Ticket", "l_extendedprice", "AVERAGE", "mean as money"),
    KpiSpec("Rows", "l_orderkey", "COUNT", "row count"),
    KpiSpec("Quantity", "l_quantity", "OTHER", "plain mean"),
    KpiSpec("Absent", "no_such_column", "SUM", "missing column"),
    KpiSpec("Returned", "l_returnflag", "COUNT", "flag count"),
)


def kpi_spec(spark, sf):
    found = kpi.evaluate_kpis(
        table(spark, sf, "lineitem"), KPI_SPECS, flag_column="l_returnflag", flag_value="R"
    )
    return rounded(found, 4, "value")


def kpi_spec_decimal(spark, sf):
    """Sums of 18-digit prices and of keys, to the last digit."""
    specs = (KpiSpec("Gross", "price", "SUM", "decimal"), KpiSpec("Keys", "l_orderkey", "SUM", "long"))
    found = kpi.evaluate_kpis(_big_money(spark, sf), specs)
    return found.select("title", F.regexp_replace("display", "[$,]", "").alias("digits"), "description")


def kpi_spec_flags(spark, sf):
    """Booleans count as 0 and 1; a flag count has no separators."""
    df = _big_money(spark, sf).withColumn("taxed", F.col("l_tax") > 0.04)
    specs = (
        KpiSpec("Taxed", "taxed", "SUM", "sum"), KpiSpec("Share", "taxed", "AVERAGE", "mean as money"),
        KpiSpec("Plain", "taxed", "OTHER", "plain mean"), KpiSpec("Returned", "l_returnflag", "COUNT", "flag count"),
        KpiSpec("Text", "l_returnflag", "SUM", "no number"),
    )
    found = kpi.evaluate_kpis(df, specs, flag_column="l_returnflag", flag_value="R")
    return rounded(found, 4, "value")


def kpi_default_specs(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    specs = kpi.default_kpi_specs(df.columns, "Sales & Revenue")
    return rounded(kpi.evaluate_kpis(df, specs), 4, "value")


def kpi_scorecard(spark, sf):
    return kpi.kpi_scorecard(_domain_kpis(table(spark, sf, "lineitem"), "Sales & Revenue"))


# --- sources and sinks -------------------------------------------------------


def csv_roundtrip(spark, sf):
    """Dirty orders written as CSV and read back with inferred types."""
    path = scratch_path(spark, "orders") + ".csv"
    sinks.write_table(dirty_orders(spark, sf), path, "csv")
    return read_table(spark, path)


def json_roundtrip(spark, sf):
    path = scratch_path(spark, "customer") + ".json"
    sinks.write_table(table(spark, sf, "customer"), path, "json")
    return read_table(spark, path).select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal",
        "c_mktsegment",
    )


def csv_types(spark, sf):
    """Text columns of every inferred type, with missing tokens, read back from CSV."""
    key = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        key.cast("string").alias("whole"),
        F.when(key % 5 == 0, "NA").otherwise((key * 2).cast("string")).alias("gappy"),
        F.concat(F.lit("1234567890"), F.lpad(key.cast("string"), 10, "0")).alias("long_number"),
        F.when(key % 7 == 0, "").otherwise(F.concat(key.cast("string"), F.lit(".5"))).alias("fraction"),
        F.when(key % 3 == 0, "True").when(key % 3 == 1, "False").otherwise("NaN").alias("flag"),
        F.when(key % 11 == 0, "null").otherwise(F.concat(F.lit("x"), key.cast("string"))).alias("word"),
    )
    path = scratch_path(spark, "types") + ".csv"
    sinks.write_table(df, path, "csv")
    found = read_table(spark, path)
    types = ",".join(f.dataType.simpleString() for f in found.schema.fields)
    return found.select(*[F.col(c).cast("string") for c in found.columns], F.lit(types).alias("types"))


def _csv_lines(spark, sf, line) -> str:
    """The orders as lines of CSV files, each with a header row; a pattern of their folders."""
    path, header = scratch_path(spark, "lines"), "key,state,note"
    part = F.col("o_orderkey") % 4
    lines = table(spark, sf, "orders").select(part.alias("part"), F.lit(1).alias("place"), line.alias("value"))
    first = spark.range(4).select(F.col("id").alias("part"), F.lit(0).alias("place"), F.lit(header).alias("value"))
    both = lines.unionByName(first).repartition("part").sortWithinPartitions("part", "place")
    both.drop("place").write.partitionBy("part").text(path)
    return f"{path}/*"


def csv_rejects(spark, sf):
    """Records with more fields than the header, or that end within a quoted field."""
    key = F.col("o_orderkey").cast("string")
    line = F.concat_ws(
        ",", key, F.col("o_orderstatus"),
        F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("surplus,"), key))
        .when(F.col("o_orderkey") % 89 == 0, F.concat(F.lit('"open '), key))
        .otherwise(F.concat(F.lit('"a, ""b"" '), key, F.lit('"'))),
    )
    return read_rejects(spark, _csv_lines(spark, sf, line))


def csv_multiline(spark, sf):
    """Quoted fields with line breaks, some of them looking like records of their own."""
    key = F.col("o_orderkey").cast("string")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"first\n7,F,second '), key, F.lit('\n\n""third"""'))).otherwise(
        F.concat(F.lit("plain "), key)
    )
    path = _csv_lines(spark, sf, F.concat_ws(",", key, F.col("o_orderstatus"), note))
    return read_table(spark, path, "csv", multi_line=True)


def cleaned_gaps(spark, sf):
    """The gaps that cleaning leaves, as counted by the write of the cleaned table."""
    df = dirty_orders(spark, sf)
    return analysis.execute(df, analysis.discover(df)).gaps


def report_tables(spark, sf):
    """The report tables, written and read back: row count, KPIs, audit."""
    df = dirty_orders(spark, sf)
    found = analysis.discover(df)
    folder = scratch_path(spark, "report")
    results = analysis.execute(df, found, certificate="formula", folder=folder)
    paths = sinks.write_report_tables(None, results.scorecard, results.audit, folder)
    cleaned = spark.read.parquet(paths["cleaned_data"]).agg(F.count("*").alias("n"))
    parts = [
        cleaned.select(
            F.lit("cleaned").alias("section"), F.lit("rows").alias("metric"),
            F.col("n").cast("string").alias("value"),
        ),
        spark.read.parquet(paths["kpi_scorecard"]).select(
            F.lit("kpi").alias("section"), F.col("kpi_metric").alias("metric"), "value"
        ),
        spark.read.parquet(paths["governance_audit"]).select(
            F.lit("audit").alias("section"), "metric", "value"
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _conversation_log(spark, sf) -> str:
    """Conversations appended to a new run log; returns its path."""
    path = scratch_path(spark, "log")
    rows = table(spark, sf, "conversations").select(
        F.col("turn").alias("id"),
        F.col("conv_id").cast("string").alias("project_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts"),
        F.lit("conversation").alias("agent"),
        F.col("role").alias("log_type"),
        F.lit(None).cast("string").alias("target_agent"),
        F.col("text").alias("message"),
        F.struct(F.length("text").alias("n_chars")).alias("payload"),
    )
    run_log.append_log(rows, path)
    return path


def _log_rows(log: DataFrame) -> DataFrame:
    return run_log.decode_payload(log, "n_chars int").select(
        "id", "project_id", "log_type", "message", F.col("payload.n_chars").alias("n_chars")
    )


def run_log_read(spark, sf):
    return _log_rows(run_log.read_log(spark, _conversation_log(spark, sf)))


def run_log_project(spark, sf):
    return _log_rows(run_log.read_log(spark, _conversation_log(spark, sf), project_id=1))


def run_log_follow(spark, sf):
    """The log followed as a stream until all present rows have arrived."""
    path = _conversation_log(spark, sf)
    out = scratch_path(spark, "followed")
    query = (
        follow_log(spark, path)
        .writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return _log_rows(spark.read.schema(run_log.SCHEMA).parquet(out))


def all_queries() -> dict[str, Query]:
    plain = (
        table_shape, table_summary, null_counts, duplicate_count, quality_score, distinct_counts,
        distinct_counts_text, numeric_summary, string_lengths, date_likeness, column_profile,
        time_series_structure_by_key, time_series_structure_by_date, derived_unit_price,
        derived_suggestions, column_roles_fast, role_tags, percentage_fields, bi_mapping,
        relationships, domain, chart_candidates, drop_duplicates, impute_median, fill_unknown,
        trim_text, standardize_dates, mixed_dates, clean_table, clean_reconciliation,
        negative_rule, negative_rule_balances, outlier_rule, outlier_rows, violations,
        violation_report, governance_score, live_certificate, governance_audit, monthly_trend,
        monthly_trend_lineitem, top_categories, top_priorities, bottom_categories, value_counts,
        value_share, scatter_points, scatter_all_points, correlation_matrix,
        correlation_with_nulls, chart_type_choice, chart_batch, chart_export, segment_means,
        segment_insights, chart_insights, kpi_sales, kpi_rate_hr, kpi_rate_churn, kpi_generic,
        kpi_spec, kpi_default_specs, kpi_scorecard, csv_roundtrip, json_roundtrip, report_tables,
        run_log_read, run_log_project, run_log_follow, date_likeness_sampled, duplicate_count_nan,
        numeric_summary_extreme, derived_totals, outlier_rule_inf, top_categories_decimal,
        correlation_inf, correlation_wide, chart_left_out, chart_batch_all, kpi_spec_decimal,
        kpi_spec_flags, csv_types, csv_rejects, csv_multiline, cleaned_gaps, frequent_values_even,
        frequent_values_skewed, column_roles_stored,
    )
    found: dict[str, Query] = {q.__name__: q for q in plain}
    found.update({f"column_roles_{t}": _roles_of(t) for t in ROLE_TABLES})
    return found


