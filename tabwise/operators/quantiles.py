"""Exact medians in two scans that never hold a whole column in one task.

A mergeable sketch, taken along with other statistics, gives for each column two values
between which the median lies, and few others.  The second scan counts what is below and
writes what is between, by value.  Ranks are then selected among those, bucket by bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions.columns import aggregate_long, by_position, entries_per_row, number_of
from tabwise.functions.staging import stage

BUCKETS = 4_096
SKETCH_ACCURACY = 10_000
LARGEST = 1.7976931348623157e308
SMALLEST_NORMAL = 2.2250738585072014e-308
#: No double but zero has an exponent below its negative.
LOWEST_EXPONENT = 1075.0


class Spread(NamedTuple):
    """Count, minimum and maximum of a column's values, and two values around its median."""

    count: int
    low: float | None
    high: float | None
    bracket: Sequence[float] | None = None


def bracket(number: Column) -> Column:
    """Two values around the median: ranks that lie twice the sketch's error away from it."""
    margin = 2 / SKETCH_ACCURACY
    return F.percentile_approx(number, [0.5 - margin, 0.5 + margin], SKETCH_ACCURACY)


class _Range(NamedTuple):
    """Closed value range holding both middle ranks; ``below`` values precede it."""

    low: float
    high: float
    below: int
    ranks: tuple[int, int]


def spreads(df: DataFrame, columns: Sequence[str]) -> dict[str, Spread]:
    rows = aggregate_long(
        df,
        "column",
        [
            (
                c,
                {
                    "n": F.count(number_of(df, c)),
                    "low": F.min(number_of(df, c)),
                    "high": F.max(number_of(df, c)),
                    "bracket": bracket(number_of(df, c)),
                },
            )
            for c in columns
        ],
    ).collect()
    return {r["column"]: Spread(r["n"], r["low"], r["high"], r["bracket"]) for r in rows}


def _by_logarithm(low: float, high: float, step: int) -> bool:
    """Even steps first; then by logarithm while the range spans more than a factor of four."""
    if step == 0:
        return False
    if low <= 0 <= high:
        return True
    small, large = sorted((abs(low), abs(high)))
    return large / 4 > small


def _bucket(value: Column, low: float, high: float, logarithmic: bool) -> Column:
    """A bucket number that never decreases as the value grows; low and high differ in it.

    Even steps of the value, or of its signed binary logarithm counted from the smallest
    double.  Even steps are taken of a quarter, which no difference overflows.
    """
    finite = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), value))
    ends = [max(-LARGEST, min(LARGEST, v)) for v in (low, high)]
    if logarithmic:
        scaled = F.signum(finite) * (F.log2(F.nullif(F.abs(finite), F.lit(0.0))) + LOWEST_EXPONENT)
        scaled = F.coalesce(scaled, F.lit(0.0))
        start, end = (math.copysign(math.log2(abs(v)) + LOWEST_EXPONENT, v) if v else 0.0 for v in ends)
    else:
        huge = max(map(abs, ends)) > LARGEST / 4
        scaled, (start, end) = (finite / 4, (v / 4 for v in ends)) if huge else (finite, ends)
    if start == end or (end - start) * BUCKETS < SMALLEST_NORMAL:
        number = F.when(value > low, 1).otherwise(0)
    else:
        number = F.floor((scaled - start) / F.lit(end - start) * BUCKETS)
    return F.when(value.isNotNull(), number).cast("int")


def _split(
    df: DataFrame, values: dict[str, Column], weight: Column, ranges: dict[str, _Range], step: int
) -> dict[str, list]:
    """One pass: the buckets of each range that hold its middle ranks.

    Each row of ``df`` stands for ``weight`` rows.  They are counted per bucket map-side;
    at most ``BUCKETS`` rows per column are ordered, and one or two per column come back.
    """
    wide = df.select(
        weight.alias("w"),
        *[
            F.when(values[c].between(r.low, r.high), values[c]).alias(f"v{i}")
            for i, (c, r) in enumerate(ranges.items())
        ],
    )
    groups = []
    for i, r in enumerate(ranges.values()):
        v = F.col(f"v{i}")
        bucket = _bucket(v, r.low, r.high, _by_logarithm(r.low, r.high, step))
        groups.append({"bucket": bucket, "v": v, "w": F.col("w")})
    counted = (
        entries_per_row(wide, groups)
        .where(F.col("v").isNotNull())
        .groupBy("position", "bucket")
        .agg(F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    targets = F.array(
        *[
            by_position([r.ranks[k] - r.below for r in ranges.values()])
            for k in range(2)
        ]
    )
    in_order = Window.partitionBy("position").orderBy("bucket")
    middle = (
        counted.withColumn("upto", F.sum("n").over(in_order))
        .withColumn("before", F.col("upto") - F.col("n"))
        .where(
            F.exists(targets, lambda rank: (F.col("before") <= rank) & (rank < F.col("upto")))
        )
        .select("position", "low", "high", "before")
        .collect()
    )
    found: dict[str, list] = {c: [] for c in ranges}
    names = list(ranges)
    for row in middle:
        found[names[row["position"]]].append(row)
    return {c: sorted(rows, key=lambda r: r["before"]) for c, rows in found.items()}


def _between(df: DataFrame, ranges: dict[str, _Range]) -> DataFrame:
    """(position, v, n), written once: how many values lie below each range (v is NULL), and
    how often each value within it occurs.

    All that is below counts as one value and is combined map-side, as equal values are.
    """
    groups = []
    for c, r in ranges.items():
        value = number_of(df, c)
        groups.append({"v": F.when(value >= r.low, value), "counted": value <= r.high})
    cells = entries_per_row(df, groups).where("counted")
    return stage(cells.groupBy("position", "v").agg(F.count("*").alias("n")), "middle-values")


def exact_medians(
    df: DataFrame, columns: Sequence[str], known: dict[str, Spread] | None = None
) -> dict[str, float | None]:
    """The median of each column, linearly interpolated; None without values.

    One scan for the spreads, where they are not ``known``, and one for the values in
    their brackets.  A column whose bracket should miss its middle ranks is searched over
    its whole range instead, in passes of their own.
    """
    if known is None:
        known = spreads(df, columns) if columns else {}
    result: dict[str, float | None] = {}
    ranges: dict[str, _Range] = {}
    for c in columns:
        n, low, high, middle = known[c]
        if not n:
            result[c] = None
        elif low == high:
            result[c] = low
        else:
            low, high = middle or (low, high)
            ranges[c] = _Range(low, high, 0, ((n - 1) // 2, n // 2))
    if not ranges:
        return result
    values = _between(df, ranges)
    sides = values.groupBy("position").agg(
        F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("below"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("within"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    )
    found = {r["position"]: r for r in sides.collect()}
    inside, missed = {}, {}
    for i, (c, r) in enumerate(ranges.items()):
        side = found.get(i)
        below, within = (side["below"] or 0, side["within"] or 0) if side else (0, 0)
        if below <= r.ranks[0] and r.ranks[1] < below + within:
            inside[c] = _Range(side["low"], side["high"], below, r.ranks)
        else:
            missed[c] = _Range(known[c].low, known[c].high, 0, r.ranks)
    place = {c: i for i, c in enumerate(ranges)}
    picked = {c: F.when(F.col("position") == place[c], F.col("v")) for c in inside}
    result |= _select(values, picked, F.col("n"), inside)
    return result | _select(df, {c: number_of(df, c) for c in missed}, F.lit(1), missed)


def _select(
    df: DataFrame, values: dict[str, Column], weight: Column, ranges: dict[str, _Range]
) -> dict[str, float]:
    """The mean of the two middle ranks of each range.

    Each pass splits the range around the middle ranks into buckets and keeps
    the one that holds them, for all columns together, until the two middle
    values are known.  Evenly spread values take two passes, few distinct ones
    take one.  The second pass leaves a factor of about two, and each later one a
    4096th of a range of 53 bits, so that no data take more than eight.
    """
    result: dict[str, float] = {}
    step = 0
    while ranges:
        remaining = {}
        for c, r in list(ranges.items()):
            if r.low == r.high:
                result[c] = r.low
                del ranges[c]
        for c, rows in (_split(df, values, weight, ranges, step) if ranges else {}).items():
            first, last = rows[0], rows[-1]
            if len(rows) == 2:
                # Neighbouring ranks in different buckets: one's last, the other's first.
                result[c] = first["high"] / 2 + last["low"] / 2
            elif first["low"] == first["high"]:
                result[c] = first["low"]
            else:
                old = ranges[c]
                remaining[c] = _Range(
                    first["low"], first["high"], old.below + first["before"], old.ranks
                )
        ranges, step = remaining, step + 1
    return result


def medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """(column, median) of numeric columns; ``exact=False`` is one sketch pass."""
    if columns and not exact:
        return aggregate_long(
            df,
            "column",
            [
                (c, {"median": F.percentile_approx(number_of(df, c), 0.5, SKETCH_ACCURACY)})
                for c in columns
            ],
        )
    found = exact_medians(df, columns)
    return df.sparkSession.createDataFrame(list(found.items()), "column string, median double")
