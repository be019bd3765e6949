"""Chart series: trends, top-N, counts, scatter points, correlations.

A batch of charts is returned in long form, one row per drawn value:
``chart_id, chart_type, slot, title, pos, label, series, x, value``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions.columns import (
    PAIR_LIMIT,
    by_position,
    entries_per_row,
    exact_sum,
    number_of,
    ref,
    short_methods,
    summable,
    value_of,
)
from tabwise.functions.dates import date_of, month_label

TOP_CATEGORIES = 10
TOP_COUNTS = 6
SCATTER_POINTS = 150
FEW_CATEGORIES = 10
MAX_CHARTS = 6
PRIMARY_CHARTS = 4
TOP_SEGMENTS = 5
PAIRS_PER_PASS = 300
#: A spread this far below the squares of the values may be rounding.
LOST_SPREAD = 1e-9


# --- single series -----------------------------------------------------------


def _sum_by(df: DataFrame, label: Column, y: str) -> DataFrame:
    """(label, value): totals per label; NULL labels dropped, empty sums are 0.

    Whole numbers and decimals stay exact, in a wider type of their own.
    """
    return (
        df.select(label.alias("label"), summable(df, y).alias("v"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.coalesce(exact_sum(F.col("v"), df.schema[y].dataType), F.lit(0)).alias("value"))
    )


def monthly_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Sum of ``y`` per calendar month of ``x``, in order; empty months are absent."""
    return _sum_by(df, month_label(date_of(df, x)), y).orderBy("label")


def top_categories(df: DataFrame, x: str, y: str, n: int = TOP_CATEGORIES) -> DataFrame:
    return (
        _sum_by(df, value_of(df, x).cast("string"), y).orderBy(F.desc("value"), "label").limit(n)
    )


def bottom_categories(df: DataFrame, x: str, y: str, n: int = TOP_CATEGORIES) -> DataFrame:
    return (
        _sum_by(df, value_of(df, x).cast("string"), y).orderBy("value", "label").limit(n)
    )


def value_counts(df: DataFrame, x: str, n: int = TOP_COUNTS) -> DataFrame:
    """The most frequent values with their row counts; NULL is not counted."""
    return (
        df.select(value_of(df, x).cast("string").alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count("*").alias("value"))
        .orderBy(F.desc("value"), "label")
        .limit(n)
    )


#: Labels that the sketch of frequent values tracks, and how many of them are counted again.
TRACKED, CANDIDATES = 100_000, 1_000
#: A sketch of frequent values is off by this many times its rows over the labels tracked.
SKETCH_ERROR = 3.5


def frequent_values(df: DataFrame, x: str, n: int = TOP_COUNTS, tracked: int = TRACKED) -> DataFrame:
    """``value_counts`` of a column with very many labels, without shuffling them all.

    One scan keeps a mergeable sketch of frequent values; its leaders are counted
    exactly in a second.  What the sketch left out is rarer than its error bound allows,
    so the leaders are right if the n-th occurs more often than that; if not, as with
    evenly spread labels, all labels are counted.
    """
    label = value_of(df, x).cast("string").alias("label")
    labels = df.select(label).where(F.col("label").isNotNull())
    candidates = max(n, min(CANDIDATES, tracked))
    sketch = labels.agg(
        F.count("*").alias("rows"), F.expr(f"approx_top_k(label, {candidates}, {tracked})").alias("top")
    ).first()
    names = [t["item"] for t in sketch["top"] or ()]
    found = labels.where(F.col("label").isin(names)).groupBy("label").agg(F.count("*").alias("value"))
    leaders = found.orderBy(F.desc("value"), "label").limit(n).collect()
    # Twice the bound: what the sketch returns is certain to be above it, the rest is not above both.
    bound = 2 * SKETCH_ERROR * sketch["rows"] / tracked
    least_named = min((t["count"] for t in sketch["top"] or ()), default=0)
    bound = max(bound, least_named + bound / 2 if len(names) == candidates else 0)
    if len(leaders) < n or leaders[-1]["value"] <= bound:
        return value_counts(df, x, n)
    return df.sparkSession.createDataFrame(leaders, "label string, value bigint")


def value_share(df: DataFrame, x: str, n: int = TOP_COUNTS) -> DataFrame:
    """``value_counts`` with each value's percent of the shown total."""
    shown = value_counts(df, x, n)
    total = F.sum("value").over(Window.partitionBy())
    return shown.withColumn("share", F.round(F.col("value") * 100 / total, 1))


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    order_by: Sequence[str] = (),
    limit: int | None = SCATTER_POINTS,
    sample_by: str | None = None,
) -> DataFrame:
    """(pos, label, x, y) of the first rows that have both values.

    "First" is by ``order_by`` and then the values; ``sample_by='hash'`` takes
    the same number spread over the table instead.  ``limit=None`` gives every
    point, unnumbered.
    """
    points = df.select(
        *[ref(c).alias(f"k{i}") for i, c in enumerate(order_by)],
        number_of(df, x).alias("x"),
        number_of(df, y).alias("y"),
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if limit is None:
        return points.select("x", "y")
    keys = [f"k{i}" for i in range(len(order_by))]
    order = [*keys, "x", "y"]
    if sample_by == "hash":
        order = [F.xxhash64(*keys, "x", "y"), *order]
    elif sample_by is not None:
        raise ValueError(f"unknown sampling: {sample_by}")
    first = points.orderBy(*order).limit(limit)
    # At most ``limit`` rows are numbered here.
    pos = F.row_number().over(Window.orderBy(*order)) - 1
    return first.select(
        pos.alias("pos"),
        F.concat(F.lit("Rec "), pos.cast("string")).alias("label"),
        "x",
        "y",
    )


def segment_means(
    df: DataFrame, segment: str, measure: str, n: int = TOP_SEGMENTS
) -> DataFrame:
    """The segments with the highest mean."""
    return (
        df.select(ref(segment).cast("string").alias("label"), number_of(df, measure).alias("v"))
        .where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.avg("v").alias("value"))
        .orderBy(F.desc_nulls_last("value"), "label")
        .limit(n)
    )


# --- correlations ------------------------------------------------------------


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, r): Pearson correlation of all pairs, both ways, and the diagonal.

    Over rows that have both values; 0 where it is undefined, as for a constant column.
    Two scans whatever the number of columns: one finds counts, means and ranges, and one
    adds up Gram matrices of the centred and scaled columns, and of their masks, so that
    every pair gets the sums over its common rows.  A pair whose common rows leave hardly
    any spread, or a column with infinities, is summed up by itself in one more.
    """
    columns = list(dict.fromkeys(columns))
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "col_a string, col_b string, r double")
    numbers = df.select(*[number_of(df, c).alias(f"n{i}") for i, c in enumerate(columns)])
    # The tasks read NaN as a gap, so the columns go to them as they are.
    plain = df.select(*[ref(c).cast("double").alias(f"n{i}") for i, c in enumerate(columns)])
    with short_methods(spark):
        seen = {r["a"]: r for r in _ranges(plain).collect()}
    varying = [i for i in range(len(columns)) if i in seen and seen[i]["low"] != seen[i]["high"]]
    tame, centres = [], {}
    for i in varying:
        mean, low, high = seen[i]["total"] / seen[i]["n"], seen[i]["low"], seen[i]["high"]
        centres[i] = (mean, max(abs(high - mean), abs(low - mean)))
        if math.isfinite(mean) and 0 < centres[i][1] < math.inf:
            tame.append(i)
    gaps = [i for i in tame if seen[i]["n"] < seen[i]["rows"]]
    known = {}
    apart = [p for p in combinations(varying, 2) if not set(p) <= set(tame)]
    if len(tame) > 1:
        with short_methods(spark):
            known, unsure = _from_sums(_gram_sums(plain, tame, centres, gaps))
        apart += unsure
    for chunk in _chunks(apart, PAIRS_PER_PASS):
        known |= {(r["a"], r["b"]): r["r"] for r in _gappy_pass(numbers, chunk).collect()}
    # What is left is known: 1 on the diagonal, 0 for columns that do not vary.
    cells = [
        (columns[a], columns[b], 1.0 if a == b and a in varying else known.get((min(a, b), max(a, b)), 0.0))
        for a in range(len(columns))
        for b in range(len(columns))
    ]
    return spark.createDataFrame(cells, "col_a string, col_b string, r double")


def _chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _value_rows(batch: pa.RecordBatch) -> np.ndarray:
    """A row of doubles per column, NaN for gaps."""
    return np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], float)


def _ranges(numbers: DataFrame) -> DataFrame:
    """(a, rows, n, total, low, high) for every column with values: all rows, and the count,
    sum and ends of the values.  A task sends one row a column."""
    k = len(numbers.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, total = 0, np.zeros(k, np.int64), np.zeros(k)
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        for batch in batches:
            values = _value_rows(batch)
            missing = np.isnan(values)
            rows += len(batch)
            n += (~missing).sum(axis=1)
            with np.errstate(invalid="ignore", over="ignore"):
                total += np.where(missing, 0.0, values).sum(axis=1)
            low = np.fmin(low, np.fmin.reduce(values, axis=1, initial=np.inf))
            high = np.fmax(high, np.fmax.reduce(values, axis=1, initial=-np.inf))
        if rows:
            columns = (np.arange(k, dtype=np.int32), np.full(k, rows), n, total, low, high)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "rows", "n", "total", "low", "high"])

    found = numbers.mapInArrow(run, "a int, rows long, n long, total double, low double, high double")
    sums = [F.sum(c).alias(c) for c in ("rows", "n", "total")]
    return found.groupBy("a").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")).where("n > 0")


#: Common rows, products, and the sums of values and squares of a and of b over them.
SUMS = ("n", "sum_ab", "sum_a", "sum_b", "sum_aa", "sum_bb")


def _gram_sums(
    numbers: DataFrame, used: Sequence[int], centres: dict[int, tuple[float, float]], gaps: Sequence[int]
) -> DataFrame:
    """(a, b, *SUMS) for every pair of columns, a < b.

    A task multiplies its batches, values by values and values by masks, and sends one
    row a pair; these are added up by pair, so no task or the driver holds a matrix of rows.
    """
    k = len(used)
    mean, scale = (np.array([[centres[i][j]] for i in used]) for j in (0, 1))
    any_gaps = bool(gaps)
    rows, cols = np.triu_indices(k, 1)
    names = np.array(used, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = 0, np.zeros((k, k))
        common, sums, squares = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            total += len(batch)
            values = (_value_rows(batch) - mean) / scale
            if any_gaps:
                mask = ~np.isnan(values)
                values[~mask] = 0.0
                mask = mask.astype(float)
                common += mask @ mask.T
                sums += values @ mask.T
                squares += (values * values) @ mask.T
            else:
                sums += values.sum(axis=1)[:, None]
                squares += (values * values).sum(axis=1)[:, None]
            products += values @ values.T
        if total:
            if not any_gaps:
                common += total
            parts = (common, products, sums, sums.T, squares, squares.T)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[rows]), pa.array(names[cols]), *[pa.array(p[rows, cols]) for p in parts]], ["a", "b", *SUMS]
            )

    schema = "a int, b int, " + ", ".join(f"{n} double" for n in SUMS)
    found = numbers.select(*[f"n{i}" for i in used]).mapInArrow(run, schema)
    return found.groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in SUMS])


def _from_sums(sums: DataFrame) -> tuple[dict[tuple[int, int], float], list[tuple[int, int]]]:
    """r of each pair, and the pairs whose spread is lost in rounding; one row a pair."""
    known, unsure = {}, []
    for r in sums.collect():
        pair, n = (r["a"], r["b"]), r["n"]
        if n < 2:
            known[pair] = 0.0
            continue
        squares = [r["sum_aa"], r["sum_bb"]]
        spreads = [q - s * s / n for q, s in zip(squares, (r["sum_a"], r["sum_b"]))]
        if any(s <= LOST_SPREAD * q for s, q in zip(spreads, squares)):
            unsure.append(pair)
            continue
        value = (r["sum_ab"] - r["sum_a"] * r["sum_b"] / n) / (math.sqrt(spreads[0]) * math.sqrt(spreads[1]))
        known[pair] = max(-1.0, min(1.0, value))
    return known, unsure


def _gappy_pass(numbers: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    groups = []
    for i, j in pairs:
        x, y = F.col(f"n{i}"), F.col(f"n{j}")
        # Rows with a gap stay as empty entries, so every pair keeps a group.
        groups.append({"x": F.when(y.isNotNull(), x), "y": F.when(x.isNotNull(), y)})
    r = F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    found = entries_per_row(numbers, groups).groupBy("position").agg(r.alias("r"))
    left, right = (by_position([p[k] for p in pairs]) for k in (0, 1))
    return found.select(left.alias("a"), right.alias("b"), F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)).alias("r"))


# --- choosing and batching charts --------------------------------------------


class Chart(NamedTuple):
    chart_id: str
    chart_type: str
    x: str | None
    y: str | None
    title: str
    slot: str


class ColumnRole(NamedTuple):
    role: str
    distinct: int


def column_roles(columns: DataFrame) -> dict[str, ColumnRole]:
    """Role and distinct count per column; one row per column of the schema."""
    rows = columns.orderBy("pos").select("column", "role", "distinct").collect()
    return {r["column"]: ColumnRole(r["role"], r["distinct"]) for r in rows}


def chart_type_of(x_role: Column, y_role: Column, x_distinct: Column, asked: Column) -> Column:
    """The chart type for a pair of columns; ``asked`` where no rule applies."""
    segment = x_role.isin("Categorical", "Boolean")
    few = x_distinct <= FEW_CATEGORIES
    return (
        F.when(x_role.isNull(), "heatmap")
        .when((x_role == "Date") & (y_role == "Numerical"), "line")
        .when(segment & y_role.isNull() & few, "pie")
        .when(segment & y_role.isNull(), "horizontalBar")
        .when(segment & (y_role == "Numerical") & few, "bar")
        .when(segment & (y_role == "Numerical"), "horizontalBar")
        .when((x_role == "Numerical") & (y_role == "Numerical"), "scatter")
        .otherwise(asked)
    )


#: Why an asked pair gets no chart.
NO_COLUMN, IDENTIFIER = "no such column", "identifier"
ASKED_BEFORE, BEYOND_LIMIT = "asked before", "beyond the limit"


def _judged_pairs(columns: DataFrame, pairs: Sequence[tuple], max_charts: int | None) -> DataFrame:
    """The asked pairs with their chart types, and the reason for those left out."""
    full = [(*p, *([None] * (4 - len(p)))) for p in pairs]
    asked = columns.sparkSession.createDataFrame(
        [(i, *p) for i, p in enumerate(full)],
        "pos int, x_col string, y_col string, asked string, title string",
    )
    facts = columns.select("column", "role", "distinct")
    x_side = facts.select(
        F.col("column").alias("x_col"),
        F.col("role").alias("x_role"),
        F.col("distinct").alias("x_distinct"),
    )
    y_side = facts.select(F.col("column").alias("y_col"), F.col("role").alias("y_role"))

    def usable(column: str, found: str) -> Column:
        return F.col(column).isNull() | F.coalesce(F.col(found) != "Identifier", F.lit(False))

    known = asked.join(x_side, "x_col", "left").join(y_side, "y_col", "left")
    fit = usable("x_col", "x_role") & usable("y_col", "y_role")
    repeat = F.row_number().over(Window.partitionBy("x_col", "y_col", "fit").orderBy("pos"))
    kept = F.col("fit") & (F.col("repeat") == 1)
    # One row per asked pair.
    drawn = F.count_if(kept).over(Window.orderBy("pos"))
    missing = (F.col("x_col").isNotNull() & F.col("x_role").isNull()) | (
        F.col("y_col").isNotNull() & F.col("y_role").isNull()
    )
    reason = (
        F.when(missing, NO_COLUMN)
        .when(~F.col("fit"), IDENTIFIER)
        .when(F.col("repeat") > 1, ASKED_BEFORE)
        .when(F.lit(False) if max_charts is None else F.col("drawn") > max_charts, BEYOND_LIMIT)
    )
    return (
        known.withColumn("fit", fit)
        .withColumn("repeat", repeat)
        .withColumn("drawn", drawn)
        .select(
            "pos",
            "x_col",
            "y_col",
            "title",
            chart_type_of(
                F.col("x_role"), F.col("y_role"), F.col("x_distinct"), F.col("asked")
            ).alias("chart_type"),
            reason.alias("reason"),
        )
    )


def chart_types(
    columns: DataFrame, pairs: Sequence[tuple], max_charts: int | None = MAX_CHARTS
) -> DataFrame:
    """(pos, x_col, y_col, title, chart_type) for asked (x, y[, type[, title]]) pairs.

    Pairs with an Identifier, with a column the table lacks, or asked before
    are left out; the first ``max_charts`` of the others remain, None for all.
    """
    judged = _judged_pairs(columns, pairs, max_charts)
    return judged.where(F.col("reason").isNull()).drop("reason").orderBy("pos")


def left_out(
    columns: DataFrame, pairs: Sequence[tuple], max_charts: int | None = MAX_CHARTS
) -> DataFrame:
    """(pos, x_col, y_col, reason): the asked pairs that get no chart."""
    judged = _judged_pairs(columns, pairs, max_charts)
    return judged.where(F.col("reason").isNotNull()).select("pos", "x_col", "y_col", "reason").orderBy("pos")


def plan_charts(
    columns: DataFrame, pairs: Sequence[tuple], max_charts: int | None = MAX_CHARTS
) -> list[Chart]:
    """The charts to draw for the asked pairs; first four primary, the rest supporting."""
    charts = []
    for i, r in enumerate(chart_types(columns, pairs, max_charts).collect()):
        x, y, kind = r["x_col"], r["y_col"], r["chart_type"]
        charts.append(
            Chart(
                f"chart_{x}_{y}_{kind}".replace(" ", "_"),
                kind,
                x,
                y,
                r["title"] or (f"{y} by {x}" if y else f"Distribution of {x}"),
                "primary" if i < PRIMARY_CHARTS else "supporting",
            )
        )
    return charts


class Limits(NamedTuple):
    """How many values a chart of a batch draws; None for all."""

    categories: int | None = TOP_CATEGORIES
    counts: int | None = TOP_COUNTS
    points: int | None = SCATTER_POINTS


class _Series(NamedTuple):
    chart: Chart
    label: Column
    value: Column
    limit: int | None
    ordered: bool = False  # by label, not by value


def _series_of(df: DataFrame, chart: Chart, limits: Limits) -> _Series | None:
    """How a chart groups its rows; None for points and matrices."""
    if chart.x is None:
        return None
    category = value_of(df, chart.x).cast("string")
    if chart.chart_type == "line" and chart.y:
        return _Series(chart, month_label(date_of(df, chart.x)), number_of(df, chart.y), None, True)
    if chart.chart_type in ("bar", "horizontalBar") and chart.y:
        return _Series(chart, category, number_of(df, chart.y), limits.categories)
    if chart.chart_type in ("pie", "horizontalBar"):
        return _Series(chart, category, F.lit(1.0), limits.counts)
    return None


def _grouped_series(df: DataFrame, series: Sequence[_Series]) -> DataFrame:
    """All grouped charts in one scan and one shuffle.

    Each row gives one (chart, label, value) entry per chart; they are summed
    map-side as pairs, then ranked.  The rank limit is pushed below the ranking shuffle,
    so a chart over a key with many values sends only its leaders.  A month is
    its own ranking group, so no month is ever dropped; neither is a label of a chart
    without a limit.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("chart"), s.label.alias("label"), s.value.cast("double").alias("v")
            )
            for i, s in enumerate(series)
        ]
    )
    lines = [i for i, s in enumerate(series) if s.ordered]
    whole = [i for i, s in enumerate(series) if s.limit is None]
    most = max((s.limit for s in series if s.limit is not None), default=1)
    limits = F.create_map(
        *[part for i, s in enumerate(series) for part in (F.lit(i), F.lit(s.limit or 1))]
    )
    is_line = F.col("chart").isin(*lines) if lines else F.lit(False)
    is_whole = F.col("chart").isin(*whole) if whole else F.lit(False)
    coarse = F.when(F.abs("v") < PAIR_LIMIT, F.col("v").cast("float").cast("double")).otherwise(F.col("v"))
    fine = F.when(F.abs("v") < PAIR_LIMIT, F.col("v") - coarse).when(F.col("v").isNotNull(), 0.0)
    sums = (
        df.select(F.inline(entries))
        .where(F.col("label").isNotNull())
        .groupBy("chart", "label")
        .agg(F.coalesce(F.sum(coarse) + F.sum(fine), F.lit(0.0)).alias("value"))
        .withColumn("group", F.when(is_whole, F.col("label")).otherwise(F.lit("")))
    )
    by_value = Window.partitionBy("chart", "group").orderBy(F.desc("value"), "label")
    leaders = (
        sums.withColumn("rank", F.row_number().over(by_value))
        .where(F.col("rank") <= most)
        .where(F.col("rank") <= limits[F.col("chart")])
    )
    # Months and the leaders of each chart are numbered here.
    in_chart = Window.partitionBy("chart").orderBy(F.when(is_line, F.col("label")), F.desc("value"), "label")
    return leaders.select(
        "chart",
        (F.row_number().over(in_chart) - 1).alias("pos"),
        "label",
        F.lit(None).cast("string").alias("series"),
        F.lit(None).cast("double").alias("x"),
        "value",
    )


def _heatmap(df: DataFrame, numerics: Sequence[str]) -> DataFrame:
    order = {c: i for i, c in enumerate(numerics)}
    index = F.create_map(*[part for c, i in order.items() for part in (F.lit(c), F.lit(i))])
    return correlation_matrix(df, numerics).select(
        (index[F.col("col_a")] * len(order) + index[F.col("col_b")]).alias("pos"),
        F.col("col_a").alias("label"),
        F.col("col_b").alias("series"),
        F.lit(None).cast("double").alias("x"),
        F.col("r").alias("value"),
    )


def chart_batch(
    df: DataFrame,
    charts: Sequence[Chart],
    numerics: Sequence[str] = (),
    order_by: Sequence[str] = (),
    limits: Limits = Limits(),
) -> DataFrame:
    """All series of a dashboard in long form.

    Every grouped chart shares one scan and one shuffle; each scatter is a
    top-k over its two columns and the heatmap one aggregate over the numeric
    ones, so nothing needs caching.  ``numerics`` are the heatmap's columns.
    """
    parts = []
    series = [s for s in (_series_of(df, c, limits) for c in charts) if s is not None]
    if series:
        described = F.array(*[_description(s.chart) for s in series])
        grouped = _grouped_series(df, series)
        parts.append(
            grouped.withColumn("about", F.get(described, F.col("chart"))).select(
                "about.*", "pos", "label", "series", "x", "value"
            )
        )
    for chart in charts:
        if chart.chart_type == "scatter" and chart.x and chart.y:
            points = scatter_points(df, chart.x, chart.y, order_by, limits.points)
            if limits.points is None:  # every point, unnumbered
                points = points.withColumns({"pos": F.lit(None).cast("int"), "label": F.lit(None).cast("string")})
            points = points.select(
                "pos", "label", F.lit(None).cast("string").alias("series"), "x",
                F.col("y").alias("value"),
            )
        elif chart.chart_type == "heatmap" and len(numerics) >= 2:
            points = _heatmap(df, numerics)
        else:
            continue
        parts.append(points.select(_description(chart).alias("about"), "*").select("about.*", *points.columns))
    if not parts:
        return df.sparkSession.createDataFrame(
            [],
            "chart_id string, chart_type string, slot string, title string, pos int, label string, "
            "series string, x double, value double",
        )
    return reduce(DataFrame.unionByName, parts)


def _description(chart: Chart) -> Column:
    return F.struct(
        F.lit(chart.chart_id).alias("chart_id"),
        F.lit(chart.chart_type).alias("chart_type"),
        F.lit(chart.slot).alias("slot"),
        F.lit(chart.title).alias("title"),
    )
