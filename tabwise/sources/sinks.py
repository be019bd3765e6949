"""Writers: tables, the report tables, chart data as JSON."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabwise.functions.columns import kinds, ref

#: The cleaned table's place among the report tables.
CLEANED_DATA = "cleaned_data"
WRITE_FORMATS = ("parquet", "csv", "json")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table, replacing what is there; CSV carries a header row."""
    if fmt not in WRITE_FORMATS:
        raise ValueError(f"Unsupported file format: {fmt}")
    if fmt == "csv":
        nested = [c for c, k in kinds(df).items() if k == "nested"]
        df.withColumns({c: F.to_json(ref(c)) for c in nested}).write.mode("overwrite").csv(
            path,
            header=True,
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def write_measured(
    df: DataFrame, path: str, metrics: Mapping[str, Column], fmt: str = "parquet"
) -> dict[str, Any]:
    """Write a table and return aggregates of the rows written, which the write carries.

    The aggregates are collected by the tasks that write, after the last shuffle, so that
    no row is counted twice and none is read again.
    """
    observed = Observation()
    write_table(df.observe(observed, *[m.alias(n) for n, m in metrics.items()]), path, fmt)
    return observed.get


def chart_json(batch: DataFrame) -> DataFrame:
    """One row per chart with its title, where there is one, and its points in order.

    A chart holds a bounded number of points: months, ten leaders, 150 scatter
    points, or the squared number of numeric columns.
    """
    point = F.struct("pos", "label", "series", "x", "value")
    chart = [c for c in ("chart_id", "chart_type", "slot", "title") if c in batch.columns]
    return batch.groupBy(*chart).agg(
        F.sort_array(F.collect_list(point)).alias("points")
    )


def write_chart_json(batch: DataFrame, path: str) -> None:
    chart_json(batch).write.mode("overwrite").json(path)


def write_report_tables(
    cleaned: DataFrame | None, scorecard: DataFrame, audit: DataFrame, folder: str, fmt: str = "parquet"
) -> dict[str, str]:
    """Write the three report tables and return their paths.

    ``cleaned=None`` says that the cleaned table has been written to its place already.
    """
    paths = {
        CLEANED_DATA: f"{folder}/{CLEANED_DATA}",
        "kpi_scorecard": f"{folder}/kpi_scorecard",
        "governance_audit": f"{folder}/governance_audit",
    }
    for table, path in zip((cleaned, scorecard, audit), paths.values()):
        if table is not None:
            write_table(table, path, fmt)
    return paths
