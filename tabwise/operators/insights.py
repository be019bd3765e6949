"""Insight rows built from segment means and charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.functions import display
from tabwise.operators.charts import Chart, segment_means

# Wording of the insight rows.
SEGMENT_FINDING = "The segment '%s' displays the highest metric average at %s."
SEGMENT_TEXTS = (
    "Concentration of performance in a single category creates structural dependency risks.",
    "Scale operations in this high-performing segment to capture market share.",
    "Allocate 15% more budget/resources to this category in Q3.",
)
SEGMENT_CONFIDENCE = 96
VOLUME_FINDING = "Total volume across all %d records is distributed unevenly across secondary cohorts."
VOLUME_TEXTS = (
    "Underperforming cohorts drain capital without returning positive margins.",
    "Optimize low-yielding cohorts by standardizing operations.",
    "Conduct a performance review of the bottom-quartile segments.",
)
VOLUME_CONFIDENCE = 90
NO_SEGMENT, NO_VALUE = "Primary Segment", "N/A"
CHART_FINDING = "Significant variance or pattern detected in %s."
CHART_EVIDENCE = "Analyzed %d records across %s and %s."
CHART_IMPACT = "Understanding relationships between {x} and {y} enables key margin improvements."
CHART_CONFIDENCE = "High"
NO_MEASURE = "distribution"

MAX_INSIGHTS = 5


def _insight(pos: int, finding, texts: Sequence[str], confidence: int):
    risk, opportunity, action = texts
    return F.struct(
        F.lit(pos).alias("pos"),
        finding.alias("finding"),
        F.lit(risk).alias("risk"),
        F.lit(opportunity).alias("opportunity"),
        F.lit(action).alias("action"),
        F.lit(confidence).alias("confidence_score"),
    )


def segment_insights(df: DataFrame, segment: str, measure: str) -> DataFrame:
    """Two rows: the best segment with its mean, and the volume note."""
    best = (
        segment_means(df, segment, measure, 1)
        .agg(F.first("label").alias("label"), F.first("value").alias("value"))
        .select(F.struct("*"))
        .scalar()
    )
    top = F.format_string(
        SEGMENT_FINDING,
        F.coalesce(best["label"], F.lit(NO_SEGMENT)),
        F.coalesce(display.number(best["value"]), F.lit(NO_VALUE)),
    )
    rows = df.agg(F.count("*").alias("n"))
    return rows.select(
        F.inline(
            F.array(
                _insight(0, top, SEGMENT_TEXTS, SEGMENT_CONFIDENCE),
                _insight(
                    1, F.format_string(VOLUME_FINDING, "n"), VOLUME_TEXTS, VOLUME_CONFIDENCE
                ),
            )
        )
    )


def chart_insights(
    df: DataFrame,
    charts: Sequence[Chart],
    max_insights: int | None = MAX_INSIGHTS,
    rows: int | None = None,
) -> DataFrame:
    """One row per chart, ``max_insights`` at most (None: all): the record count and the two columns.

    A known number of ``rows`` saves the count.
    """
    lines = []
    for pos, chart in enumerate(charts[:max_insights]):
        x, y = str(chart.x), chart.y or NO_MEASURE
        lines.append(
            F.struct(
                F.lit(pos).alias("pos"),
                F.format_string(CHART_FINDING, F.lit(chart.title)).alias("finding"),
                F.format_string(CHART_EVIDENCE, F.col("n"), F.lit(x), F.lit(y)).alias("evidence"),
                F.lit(CHART_IMPACT.format(x=x, y=y)).alias("business_impact"),
                F.lit(CHART_CONFIDENCE).alias("confidence"),
            )
        )
    if not lines:
        return df.sparkSession.createDataFrame(
            [],
            "pos int, finding string, evidence string, business_impact string, confidence string",
        )
    counted = df.agg(F.count("*").alias("n")) if rows is None else df.sparkSession.createDataFrame([(rows,)], "n bigint")
    return counted.select(F.inline(F.array(*lines)))
