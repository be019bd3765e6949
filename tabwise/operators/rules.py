"""Business rules: non-negative values, z-score outliers, violation report."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.functions import keywords as kw
from tabwise.functions.columns import aggregate_long, contains_any, number_of, ref

# Names, levels and wording of the rules.
NEGATIVE_RULE = "Non-negative values constraint"
NEGATIVE_TEXT = "Found %d negative entries in '%s'. Values must be >= 0."
OUTLIER_RULE = "Statistical outlier threshold"
OUTLIER_TEXT = "Found %d entries in '%s' exceeding 3 standard deviations (outliers)."
WARNING, INFO, ERROR = "WARNING", "INFO", "ERROR"

Z_LIMIT = 3.0
MIN_VALUES = 5


def non_negative_columns(columns: DataFrame) -> list[str]:
    """Numeric columns whose name says they cannot be negative."""
    named = columns.where(
        F.col("is_numeric") & contains_any(F.col("column"), kw.NON_NEGATIVE_WORDS)
    )
    return [r["column"] for r in named.orderBy("pos").select("column").collect()]


def list_numeric(columns: DataFrame) -> list[str]:
    rows = columns.where("is_numeric").orderBy("pos").select("column").collect()
    return [r["column"] for r in rows]


def _as_violations(counts: DataFrame, rule: str, text: str, severity: str) -> DataFrame:
    return counts.where(F.col("n") > 0).select(
        "column",
        F.lit(rule).alias("rule"),
        F.format_string(text, "n", "column").alias("violation_desc"),
        F.lit(severity).alias("severity"),
        F.col("n").alias("n_rows"),
    )


def _no_counts(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column string, n bigint")


def negative_rule(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One WARNING per column with negative values; all columns in one pass."""
    counts = (
        aggregate_long(df, "column", [(c, {"n": F.count_if(number_of(df, c) < 0)}) for c in columns])
        if columns
        else _no_counts(df)
    )
    return _as_violations(counts, NEGATIVE_RULE, NEGATIVE_TEXT, WARNING)


class Moments(NamedTuple):
    """What both rules need to know of a column: values, mean, sample deviation, negatives."""

    count: int
    mean: float | None
    deviation: float | None
    negative: int


def moment_aggregates(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Named aggregates from which ``moments_of`` reads the moments.

    They are centred and merge without loss, so they can ride along in any pass over the
    rows, such as the one that writes them.
    """
    found = {}
    for i, c in enumerate(columns):
        value = number_of(df, c)
        found |= {
            f"count{i}": F.count(value), f"mean{i}": F.avg(value),
            f"deviation{i}": F.stddev_samp(value), f"negative{i}": F.count_if(value < 0),
        }
    return found


def moments_of(values: Mapping[str, Any], columns: Sequence[str]) -> dict[str, Moments]:
    return {c: Moments(*[values[f"{field}{i}"] for field in Moments._fields]) for i, c in enumerate(columns)}


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    """The moments of all columns in one pass."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    aggregates = moment_aggregates(df, columns)
    return moments_of(df.agg(*[a.alias(n) for n, a in aggregates.items()]).first().asDict(), columns)


def z_scores(
    df: DataFrame, columns: Sequence[str], known: Mapping[str, Moments] | None = None
) -> list[Column]:
    """The z-score of every listed column: sample deviation, NULL where undefined.

    A column with infinite values has no finite deviation and so no scores.  The moments
    enter the plan as constants; where they are not known, one pass finds them.
    """
    known = moments(df, columns) if known is None else known

    def score(c: str) -> Column:
        m = known[c]
        if m.count <= MIN_VALUES or not m.deviation or not math.isfinite(m.deviation):
            return F.lit(None).cast("double")
        return (number_of(df, c) - m.mean) / m.deviation

    return [score(c) for c in columns]


def outlier_rule(
    df: DataFrame,
    columns: Sequence[str],
    limit: float = Z_LIMIT,
    known: Mapping[str, Moments] | None = None,
) -> DataFrame:
    """One INFO per column with values further than ``limit`` deviations out."""
    counts = (
        aggregate_long(
            df,
            "column",
            [
                (c, {"n": F.count_if(F.abs(z) > limit)})
                for c, z in zip(columns, z_scores(df, columns, known))
            ],
        )
        if columns
        else _no_counts(df)
    )
    return _as_violations(counts, OUTLIER_RULE, OUTLIER_TEXT, INFO)


def outlier_rows(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] | None = None,
    limit: float = Z_LIMIT,
) -> DataFrame:
    """The outlying rows, once per outlying column, with column, value and z."""
    kept = [ref(c) for c in (keep if keep is not None else df.columns)]
    hits = [
        F.when(
            F.abs(z) > limit,
            F.struct(
                F.lit(c).alias("column"), number_of(df, c).alias("outlier_value"), z.alias("z")
            ),
        )
        for c, z in zip(columns, z_scores(df, columns))
    ]
    return df.select(*kept, F.inline(F.array_compact(F.array(*hits))))


def violations(
    df: DataFrame,
    negative_columns: Sequence[str],
    outlier_columns: Sequence[str],
    limit: float = Z_LIMIT,
    known: Mapping[str, Moments] | None = None,
) -> DataFrame:
    """All violations: negatives first, then outliers.

    Two scans: one for the moments and negatives of all columns, which is saved where
    they are ``known``, and one that flags outliers.
    """
    known = moments(df, [*negative_columns, *outlier_columns]) if known is None else known
    negatives = df.sparkSession.createDataFrame(
        [(c, known[c].negative) for c in negative_columns], "column string, n bigint"
    )
    return _as_violations(negatives, NEGATIVE_RULE, NEGATIVE_TEXT, WARNING).unionByName(
        outlier_rule(df, outlier_columns, limit, known)
    )


def violation_report(found: DataFrame) -> DataFrame:
    """One row: list size, total, passed.  INFO rows are not in the total."""
    return found.agg(
        F.count("*").alias("violation_entries"),
        F.coalesce(F.sum(F.when(F.col("severity") != INFO, F.col("n_rows"))), F.lit(0))
        .cast("bigint")
        .alias("total_violations_count"),
        (F.count_if(F.col("severity") == ERROR) == 0).alias("validation_passed"),
    )
