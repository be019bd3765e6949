"""Dates from text and native types, without errors on bad input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions.columns import ref

# A text value looks like a date if it has one of these shapes.
DATE_SHAPE = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})$"
DATE_SHARE = 0.8

MICROS_PER_DAY = 86_400_000_000


def looks_like_date(text: Column) -> Column:
    return text.rlike(DATE_SHAPE)


def parse_text_date(text: Column) -> Column:
    """Timestamp from year-first, month-first or compact dates; else NULL.

    The pattern is rewritten to ISO order and cast once, so a bad value costs a
    failed parse and not one exception per candidate pattern.
    """
    iso = F.translate(F.trim(text), "/", "-")
    iso = F.regexp_replace(iso, r"^(\d{1,2})-(\d{1,2})-(\d{4})(?!\d)", "$3-$1-$2")
    iso = F.regexp_replace(iso, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return iso.try_cast("timestamp_ntz")


def date_of(df: DataFrame, name: str) -> Column:
    """The column as a timestamp without zone; unparseable text is NULL.

    A number is not a date here: a ``Year`` of 2020 has no instant of its own.
    """
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ref(name).cast("timestamp_ntz")
    if isinstance(data_type, T.StringType):
        return parse_text_date(ref(name))
    return F.lit(None).cast("timestamp_ntz")


def iso_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * F.lit(MICROS_PER_DAY)
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    sub_minute = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return day + seconds.cast("bigint") * F.lit(1_000_000) + sub_minute


def day_of(instant: Column) -> Column:
    """The date that ``micros`` counted from; independent of the session time zone."""
    return F.date_from_unix_date(F.floor(instant / F.lit(MICROS_PER_DAY)).cast("int"))
