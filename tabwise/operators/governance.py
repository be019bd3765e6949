"""Governance score, certificate and audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Status names and audit labels.
APPROVED = "APPROVED"
APPROVED_WITH_WARNINGS = "APPROVED_WITH_WARNINGS"
AUDIT_LABELS = (
    "Intake Rows Count",
    "Cleaned Rows Count",
    "Deduplicated Rows Removed",
    "Total Logical Violations Found",
    "Audited Compliance Score",
    "Signoff Audit Status",
    "Governance Officer",
    "Governance Verdict",
)
VERDICT_TEXT = "Audit complete. Data matches schema bounds. %d warning anomalies flagged during intake."
LIVE_VERDICT = "Data validation check completed successfully."

POINTS_PER_VIOLATION = 5
MAX_LOSS = 40


def governance_score(report: DataFrame, officer: str = "Governance QA") -> DataFrame:
    """Certificate by formula from the one-row violation report."""
    n = F.col("total_violations_count")
    loss = F.least(F.lit(MAX_LOSS).cast("bigint"), n * POINTS_PER_VIOLATION)
    return report.select(
        (F.lit(100) - loss).cast("int").alias("overall_confidence_score"),
        F.when(n == 0, APPROVED).otherwise(APPROVED_WITH_WARNINGS).alias("status"),
        F.lit(officer).alias("signoff_officer"),
        F.format_string(VERDICT_TEXT, n).alias("governance_verdict"),
    )


def live_certificate(summary: DataFrame, officer: str = "Reporting") -> DataFrame:
    """Certificate that passes the quality score on, always approved."""
    return summary.select(
        F.col("quality_score").cast("int").alias("overall_confidence_score"),
        F.lit(APPROVED).alias("status"),
        F.lit(officer).alias("signoff_officer"),
        F.lit(LIVE_VERDICT).alias("governance_verdict"),
    )


def governance_audit(
    reconciliation: DataFrame, report: DataFrame, certificate: DataFrame
) -> DataFrame:
    """(pos, metric, value): eight rows from three one-row tables."""
    rows = reconciliation.select(F.struct("*")).scalar()
    cert = certificate.select(F.struct("*")).scalar()
    values = (
        rows["before_rows"],
        rows["after_rows"],
        rows["rows_dropped"],
        F.col("total_violations_count"),
        F.concat(cert["overall_confidence_score"].cast("string"), F.lit("%")),
        cert["status"],
        cert["signoff_officer"],
        cert["governance_verdict"],
    )
    lines = [
        F.struct(
            F.lit(pos).alias("pos"),
            F.lit(label).alias("metric"),
            value.cast("string").alias("value"),
        )
        for pos, (label, value) in enumerate(zip(AUDIT_LABELS, values))
    ]
    return report.select(F.inline(F.array(*lines)))
