"""Column helpers: quoting, kinds, null-safe values, long-form aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_KINDS = ("int", "float")


def ref(name: str) -> Column:
    """A column by its exact name; dots and spaces are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.DecimalType):
        return "int" if data_type.scale == 0 else "float"
    if isinstance(data_type, T.FractionalType):
        return "float"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "nested"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k in NUMERIC_KINDS]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k not in NUMERIC_KINDS]


def value_of(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL, so averages and counts skip it."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(ref(name), F.lit(None))
    return ref(name)


def nan_to_null(df: DataFrame) -> DataFrame:
    """The table with every NaN replaced by NULL."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: value_of(df, c) for c in floats})


def number_of(df: DataFrame, name: str) -> Column:
    return value_of(df, name).cast("double")


def summable(df: DataFrame, name: str) -> Column:
    """The column in a type whose sum neither overflows nor loses digits; see ``exact_sum``."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.BooleanType):
        return ref(name).cast("bigint")
    if isinstance(data_type, T.LongType):
        return ref(name).cast("decimal(19,0)")
    if isinstance(data_type, T.IntegralType):
        return ref(name).cast("bigint")
    return ref(name) if isinstance(data_type, T.DecimalType) else number_of(df, name)


#: Beyond this a double does not fit the single-precision half of a pair.
PAIR_LIMIT = 1e38


def exact_sum(value: Column, data_type: T.DataType) -> Column:
    """The sum of ``summable`` values of a column of that type.

    Whole numbers and decimals are summed as such, in a wider type.  A double is summed
    as a pair: its first 24 bits, which add up without rounding as long as the total is no
    more than 2**28 times the single values, and the rest, 2**24 times smaller.  So cents
    survive, and the order of addition does not show.
    """
    if isinstance(data_type, (T.BooleanType, T.IntegralType, T.DecimalType)):
        return F.sum(value)
    fits = F.abs(value) < PAIR_LIMIT
    coarse = F.when(fits, value.cast("float").cast("double")).otherwise(value)
    return F.sum(coarse) + F.sum(F.when(fits, value - coarse).when(value.isNotNull(), 0.0))


def exact_total(df: DataFrame, name: str) -> Column:
    """The exact sum of a column; 0 without values."""
    return F.coalesce(exact_sum(summable(df, name), df.schema[name].dataType), F.lit(0))


def exact_mean(df: DataFrame, name: str) -> Column:
    """The exact sum as a double, by the number of values; NULL without values."""
    value = summable(df, name)
    return F.try_divide(exact_sum(value, df.schema[name].dataType).cast("double"), F.count(value))


#: HotSpot leaves methods of more bytes than this uncompiled.
COMPILED_BYTES = "8000"


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """For actions on many computed columns: Spark keeps no generated method that HotSpot
    would interpret, but makes several short ones."""
    setting = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(setting)
    spark.conf.set(setting, COMPILED_BYTES)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def contains_any(name: Column, words: Iterable[str]) -> Column:
    """True where the lower-cased text holds any of the (plain) words."""
    return F.lower(name).rlike("|".join(words))


def has_word(name: str, words: Iterable[str]) -> bool:
    lowered = name.lower()
    return any(w in lowered for w in words)


def first_with_word(names: Sequence[str], words: Iterable[str]) -> str | None:
    return next((n for n in names if has_word(n, words)), None)


def aggregate_long(
    df: DataFrame, key: str, entries: Sequence[tuple[str, dict[str, Column]]]
) -> DataFrame:
    """All aggregates of all entries in one pass, returned as one row per entry.

    ``entries`` holds (label, {field: aggregate}); every entry has the same
    fields with the same types.
    """
    wide = df.agg(
        *[
            agg.alias(f"{i}_{field}")
            for i, (_, fields) in enumerate(entries)
            for field, agg in fields.items()
        ]
    )
    rows = [
        F.struct(
            F.lit(label).alias(key), *[F.col(f"{i}_{field}").alias(field) for field in fields]
        )
        for i, (label, fields) in enumerate(entries)
    ]
    return wide.select(F.inline(F.array(*rows)))


def entries_per_row(df: DataFrame, groups: Sequence[dict[str, Column]]) -> DataFrame:
    """One row per group and input row: (position, *fields of the group).

    ``position`` numbers the groups.  A small loop over short entries with a
    whole-number key compiles well where one aggregate over hundreds of columns
    would not.
    """
    entries = [
        F.struct(F.lit(i).alias("position"), *[c.alias(n) for n, c in fields.items()])
        for i, fields in enumerate(groups)
    ]
    return df.select(F.inline(F.array(*entries)))


def by_position(values: Sequence) -> Column:
    """The entry of ``values`` that the row's ``position`` stands for."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("position"))
