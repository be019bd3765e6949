"""Numbers as display text: ``$1,234.56``, ``1,234``, ``12.3%``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _formatted(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def number(value: Column) -> Column:
    return F.format_number(value, 2)


def count(value: Column) -> Column:
    return F.format_number(value, 0)


def flag_count(value: Column) -> Column:
    """A count of flags as plain digits; a negative one counts rows, and is grouped."""
    return F.when(value > 0, value.cast("string")).otherwise(count(F.abs(value)))


def every_digit(value: Column) -> Column:
    """Grouped, with all decimals the number has and at least one."""
    return _formatted(value, "#,##0.0###############")


def two_decimals(value: Column) -> Column:
    return _formatted(value, "0.00")


def percent(value: Column) -> Column:
    return F.concat(_formatted(value, "0.0"), F.lit("%"))


def score(value: Column) -> Column:
    return F.concat(_formatted(value, "0"), F.lit("/100"))


BY_NAME = {"money": money, "number": number, "count": count, "percent": percent, "score": score}
