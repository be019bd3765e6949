"""A whole analysis: discover a table, then clean, check and describe it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.columns import non_numeric_columns, numeric_columns, value_of
from tabwise.functions.staging import scratch_path, stage
from tabwise.operators.charts import (
    MAX_CHARTS,
    Chart,
    Limits,
    chart_batch,
    column_roles,
    left_out,
    plan_charts,
)
from tabwise.operators.clean import clean, reconcile
from tabwise.operators.governance import governance_audit, governance_score, live_certificate
from tabwise.operators.insights import chart_insights, segment_insights
from tabwise.operators.kpi import DomainKpis, kpi_scorecard
from tabwise.operators.profile import column_profile, table_summary
from tabwise.operators.roles import assign_roles, detect_domain
from tabwise.operators.rules import (
    list_numeric,
    moment_aggregates,
    moments_of,
    non_negative_columns,
    violation_report,
    violations,
)
from tabwise.operators.timeseries import time_series_structure
from tabwise.sources.readers import INFERRED_MARK, format_of, read_table
from tabwise.sources.sinks import (
    CLEANED_DATA,
    write_chart_json,
    write_measured,
    write_report_tables,
    write_table,
)


@dataclass
class Discovery:
    """What is known of a table before work on it starts.

    ``columns`` and ``summary`` are written once and small (one row per column,
    one row), so later steps read them instead of profiling again.
    """

    columns: DataFrame
    summary: DataFrame
    domain: str
    time_series: DataFrame | None = None

    def names_with_role(self, *roles: str) -> list[str]:
        known = column_roles(self.columns)
        return [c for role in roles for c, found in known.items() if found.role == role]


@dataclass
class Results:
    cleaned: DataFrame
    reconciliation: DataFrame
    violations: DataFrame
    report: DataFrame
    certificate: DataFrame
    audit: DataFrame
    kpis: DataFrame
    scorecard: DataFrame
    charts: DataFrame
    insights: DataFrame
    #: Remaining nulls by column; asked pairs without a chart; insights of the first segment.
    gaps: DataFrame
    left_out: DataFrame
    segments: DataFrame | None = None
    planned: list[Chart] = field(default_factory=list)
    #: Where the cleaned table lies among the report tables already.
    folder: str | None = None

    def write(self, folder: str, fmt: str = "parquet") -> dict[str, str]:
        there = folder == self.folder and fmt == "parquet"
        paths = write_report_tables(None if there else self.cleaned, self.scorecard, self.audit, folder, fmt)
        paths |= {"charts": f"{folder}/charts", "violations": f"{folder}/violations"}
        write_chart_json(self.charts, paths["charts"])
        write_table(self.violations, paths["violations"], fmt)
        return paths


def kept(df: DataFrame) -> DataFrame:
    """A result with at most a few rows per column, fixed to its values."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def ingest(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """Read a table for several passes: text formats are written once as Parquet."""
    df = read_table(spark, path, fmt, multi_line)
    return df if (fmt or format_of(path)) == "parquet" else stage(df, "ingested")


def discover(
    df: DataFrame,
    exact: bool = True,
    order_by: Sequence[str] = (),
    nullable_ints_are_floats: bool | None = None,
) -> Discovery:
    """Profile the table and name its columns' roles and its domain.

    ``nullable_ints_are_floats``: whole numbers with gaps are never identifiers.  By
    default so where types were inferred from text, which cannot tell the two.  The time
    series is that of the first date column that holds instants (not a ``Year`` number).
    """
    if nullable_ints_are_floats is None:
        nullable_ints_are_floats = any(f.metadata.get(INFERRED_MARK) for f in df.schema.fields)
    columns = kept(assign_roles(column_profile(df, exact), nullable_ints_are_floats).orderBy("pos"))
    instants = columns.where(F.col("is_date") & F.col("kind").isin("date", "string"))
    dates = [r["column"] for r in instants.orderBy("pos").collect()]
    return Discovery(
        columns=columns,
        summary=kept(table_summary(df)),
        domain=detect_domain(columns).first()["domain"],
        time_series=time_series_structure(df, dates[0], order_by) if dates else None,
    )


def default_pairs(found: Discovery) -> list[tuple[str | None, str | None]]:
    """Chart pairs when none are asked: roles against the first measures."""
    measures = found.names_with_role("Numerical")
    segments = found.names_with_role("Categorical", "Boolean")
    dates = found.names_with_role("Date")
    pairs: list[tuple[str | None, str | None]] = []
    pairs += [(d, m) for d in dates[:1] for m in measures[:1]]
    pairs += [(s, m) for s in segments[:2] for m in measures[:1]]
    pairs += [(s, None) for s in segments[:1]]
    if len(measures) >= 2:
        pairs += [(measures[0], measures[1]), (None, None)]
    return pairs


def default_segment(df: DataFrame) -> tuple[str, str] | None:
    """The first column that is no number and the first that is one, by type."""
    segments, measures = non_numeric_columns(df), numeric_columns(df)
    return (segments[0], measures[0]) if segments and measures else None


def execute(
    df: DataFrame,
    found: Discovery,
    pairs: Sequence[tuple] | None = None,
    order_by: Sequence[str] = (),
    certificate: str = "live",
    folder: str | None = None,
    max_charts: int | None = MAX_CHARTS,
    limits: Limits = Limits(),
) -> Results:
    """Clean the table, write it once, then check rules and compute KPIs and charts on it.

    The write carries the row count, the remaining gaps, the moments for the rules and
    the KPIs, so none of them reads the table again.  It goes to ``folder``, where the
    report tables belong, or else to the shared folder; later steps scan only the columns
    they need from there.
    """
    cleaned = clean(df, found.columns)
    known = found.summary.first()
    numeric, negative = list_numeric(found.columns), non_negative_columns(found.columns)
    measures = found.names_with_role("Numerical")
    kpis = DomainKpis(
        cleaned, found.domain, measures, found.names_with_role("Boolean", "Categorical"), known["quality_score"]
    )
    checked = list(dict.fromkeys([*negative, *numeric]))
    path = f"{folder}/{CLEANED_DATA}" if folder else scratch_path(df.sparkSession, "cleaned")
    seen = write_measured(
        cleaned,
        path,
        {"rows": F.count("*")}
        | {f"gaps{i}": F.count_if(value_of(cleaned, c).isNull()) for i, c in enumerate(cleaned.columns)}
        | moment_aggregates(cleaned, checked)
        | kpis.aggregates,
    )
    cleaned = df.sparkSession.read.schema(cleaned.schema).parquet(path)
    gaps = [(c, seen[f"gaps{i}"]) for i, c in enumerate(cleaned.columns)]
    broken = kept(violations(cleaned, negative, numeric, known=moments_of(seen, checked)))
    report = violation_report(broken)
    if certificate == "live":
        signed = live_certificate(found.summary)
    elif certificate == "formula":
        signed = governance_score(report)
    else:
        raise ValueError(f"unknown certificate mode: {certificate}")
    counted = kept(reconcile(known["row_count"], seen["rows"]))
    asked = pairs if pairs is not None else default_pairs(found)
    planned = plan_charts(found.columns, asked, max_charts)
    segment = default_segment(cleaned)
    rows = kpis.rows(seen)
    return Results(
        cleaned=cleaned,
        reconciliation=counted,
        violations=broken,
        report=report,
        certificate=signed,
        audit=governance_audit(counted, report, signed),
        kpis=rows,
        scorecard=kpi_scorecard(rows),
        charts=chart_batch(cleaned, planned, measures, order_by, limits),
        insights=chart_insights(cleaned, planned, rows=seen["rows"]),
        gaps=df.sparkSession.createDataFrame(gaps, "column string, nulls bigint"),
        left_out=left_out(found.columns, asked, max_charts),
        segments=segment_insights(cleaned, *segment) if segment else None,
        planned=planned,
        folder=folder,
    )
