"""Cleaning: deduplicate, impute, fill, trim, standardize dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions import keywords as kw
from tabwise.functions.columns import kinds, nan_to_null, number_of, ref, value_of
from tabwise.functions.dates import date_of, iso_day
from tabwise.functions.staging import stage
from tabwise.operators.profile import row_fingerprint
from tabwise.operators.quantiles import exact_medians

EDGE_SPACE = r"^\s+|\s+$"


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_has_map(f.dataType) for f in data_type.fields)
    return False


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per set of equal rows (NULLs equal).

    The copies of a hot row are combined map-side.  Maps cannot be grouping
    keys; tables that hold one are grouped by row digest.
    """
    if any(_has_map(f.dataType) for f in df.schema.fields):
        return df.withColumn("_digest", row_fingerprint(df)).dropDuplicates(["_digest"]).drop("_digest")
    return df.dropDuplicates()


def impute_median(
    df: DataFrame, columns: Sequence[str], values: dict[str, float] | None = None
) -> DataFrame:
    """Fill numeric NULLs with the column's median (0 where there is none).

    ``values`` gives known medians and saves the passes that find them.  An
    integer column whose median falls between two integers becomes double.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    values = values if values is not None else exact_medians(df, columns)
    filled = {}
    for c in columns:
        fill = float(values.get(c) or 0.0)
        data_type = df.schema[c].dataType
        keeps_type = isinstance(data_type, T.FractionalType) or fill.is_integer()
        value = value_of(df, c) if keeps_type else number_of(df, c)
        fill_type = data_type if keeps_type else T.DoubleType()
        filled[c] = F.coalesce(value, F.lit(fill).cast(fill_type))
    return df.withColumns(filled)


def fill_unknown(df: DataFrame, columns: Sequence[str], fill: str = kw.UNKNOWN) -> DataFrame:
    """Fill the NULLs of text columns with a placeholder."""
    return df.withColumns({c: F.coalesce(ref(c), F.lit(fill)) for c in columns})


def trim_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strip white space of every sort from both ends."""
    return df.withColumns({c: F.regexp_replace(ref(c), EDGE_SPACE, "") for c in columns})


def standardize_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dates as ``yyyy-MM-dd`` text; what does not parse is NULL."""
    return df.withColumns({c: iso_day(date_of(df, c)) for c in columns})


def distinct_row_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Medians over the distinct rows.

    Rows are reduced to a digest and the listed columns before they are deduplicated, and
    only those columns are written for the passes that follow; whole rows never are.
    """
    columns = list(columns)
    narrow = df.select(
        row_fingerprint(df).alias("digest"), *[number_of(df, c).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    values = stage(narrow.dropDuplicates(["digest"]).drop("digest"), "distinct-values")
    found = exact_medians(values, values.columns)
    return {c: found[f"v{i}"] for i, c in enumerate(columns)}


def clean(df: DataFrame, columns: DataFrame) -> DataFrame:
    """The whole cleaning pipeline; ``columns`` is the profile with roles.

    Medians are taken of the deduplicated rows and enter the plan as constants, so the
    cleaned table is one pass over the input with one shuffle, and is written by whoever
    wants it written.
    """
    tags = columns.select("column", "nulls", "is_date", "is_numeric").collect()
    found = kinds(df)
    nulls = {r["column"] for r in tags if r["nulls"]}
    to_impute = [r["column"] for r in tags if r["is_numeric"] and r["column"] in nulls]
    dates = [r["column"] for r in tags if r["is_date"] and found[r["column"]] in ("string", "date")]
    other = [r["column"] for r in tags if not r["is_date"] and not r["is_numeric"]]
    text = [c for c in other if found[c] == "string"]
    booleans = [c for c in other if found[c] == "bool" and c in nulls]

    df = nan_to_null(df)
    rows = drop_duplicates(df)
    if to_impute:
        rows = impute_median(rows, to_impute, distinct_row_medians(df, to_impute))
    # A boolean that needs a placeholder becomes text.
    rows = rows.withColumns({c: F.initcap(ref(c).cast("string")) for c in booleans})
    rows = fill_unknown(rows, [c for c in [*text, *booleans] if c in nulls])
    return rows.transform(trim_text, text).transform(standardize_dates, dates)


def reconcile(before: DataFrame | int, after: DataFrame | int) -> DataFrame:
    """One row: rows before and after, dropped, percent retained.

    Either side may be given as a known row count, which saves its scan.
    """
    tables = [s for s in (before, after) if not isinstance(s, int)]
    spark = tables[0].sparkSession if tables else SparkSession.active()
    sides = []
    for name, side in (("before_rows", before), ("after_rows", after)):
        if isinstance(side, int):
            counted = spark.range(1).select(F.lit(side).cast("bigint").alias("n"))
        else:
            counted = side.agg(F.count("*").alias("n"))
        sides.append(counted.select(F.lit(name).alias("side"), "n"))
    both = (
        sides[0]
        .unionByName(sides[1])
        .agg(
            *[
                F.max(F.when(F.col("side") == name, F.col("n"))).alias(name)
                for name in ("before_rows", "after_rows")
            ]
        )
    )
    return both.select(
        "before_rows",
        "after_rows",
        (F.col("before_rows") - F.col("after_rows")).alias("rows_dropped"),
        (F.try_divide(F.col("after_rows"), F.col("before_rows")) * 100).alias("retention_pct"),
    )
