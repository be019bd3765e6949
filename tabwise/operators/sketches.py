"""Distinct counts from stored sketches that merge.

A sketch of a column's different values is a few kilobytes whatever their number, and the
sketches of two parts of a table make that of both.  Stored by day or by load, they give
the counts of the whole table without reading it: a new part costs one scan of itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.columns import kinds, value_of
from tabwise.operators.profile import distinct_sketch

SKETCHES = "part string, column string, rows bigint, nulls bigint, sketch binary"


def column_sketches(df: DataFrame, part: Column | str = "") -> DataFrame:
    """(part, column, rows, nulls, sketch): for each part of the table and each column.

    One aggregate; nested columns have no sketch.  ``part`` is a column expression, such
    as the day, or the name of the whole table's part.
    """
    label = F.lit(part) if isinstance(part, str) else part.cast("string")
    columns = [c for c, k in kinds(df).items() if k != "nested"]
    aggregates = []
    for i, c in enumerate(columns):
        aggregates += [
            distinct_sketch(df, c).alias(f"sketch{i}"), F.count_if(value_of(df, c).isNull()).alias(f"nulls{i}"),
        ]
    wide = df.groupBy(label.alias("part")).agg(F.count("*").alias("rows"), *aggregates)
    rows = [
        F.struct(
            F.lit(c).alias("column"), "rows", F.col(f"nulls{i}").alias("nulls"), F.col(f"sketch{i}").alias("sketch")
        )
        for i, c in enumerate(columns)
    ]
    return wide.select("part", F.inline(F.array(*rows)))


def append_sketches(sketches: DataFrame, path: str) -> None:
    """Store the sketches of new parts beside those already there."""
    sketches.write.mode("append").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The stored sketches; a part that was stored twice, as after a repeated load, counts
    once, with the sketch that saw most rows."""
    stored = spark.read.schema(SKETCHES).parquet(path)
    best = F.max_by(F.struct("rows", "nulls", "sketch"), "rows").alias("best")
    return stored.groupBy("part", "column").agg(best).select("part", "column", "best.*")


def merged_counts(sketches: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct): over all parts; distinct is an estimate."""
    return sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"),
    )
