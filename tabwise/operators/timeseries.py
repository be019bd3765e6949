"""Structure of a date column: span, sortedness, modal step."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions.columns import ref
from tabwise.functions.dates import MICROS_PER_DAY, date_of, day_of, iso_day, micros
from tabwise.functions.staging import stage


def frequency_label(step: Column) -> Column:
    """1 day, 7 days, 28 to 31 days; anything else is irregular."""
    return (
        F.when(step == 1, "Daily")
        .when(step == 7, "Weekly")
        .when(step.between(28, 31), "Monthly")
        .otherwise("Irregular")
    )


#: (step, n) rows count steps; edge rows have no step but ``edge`` with a partition's ends.
FOLDED = (
    "part int, step long, n long, edge struct<first: long, last: long, low: long, high: long, back: long>"
)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition as a summary: step counts, and the ends that join it to others.

    Summaries of neighbouring partitions add up to that of both, with one more step from
    the one's last instant to the other's first, so a partition of any size is folded as it
    streams by.
    """
    part = TaskContext.get().partitionId()
    steps: Counter[int] = Counter()
    first = last = low = high = None
    back = 0
    for batch in batches:
        t = batch.column(0).to_numpy()
        copies = batch.column(1).to_numpy()
        if not len(t):
            continue
        deltas = np.diff(t) if last is None else np.diff(t, prepend=last)
        back += int((deltas < 0).sum())
        found, n = np.unique(np.floor_divide(deltas, MICROS_PER_DAY), return_counts=True)
        steps.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
        steps[0] += int((copies - 1).sum())
        first = int(t[0]) if first is None else first
        last = int(t[-1])
        low = int(t.min()) if low is None else min(low, int(t.min()))
        high = int(t.max()) if high is None else max(high, int(t.max()))
    if first is None:
        return
    rows = [{"part": part, "step": s, "n": n, "edge": None} for s, n in steps.items() if n]
    edge = {"first": first, "last": last, "low": low, "high": high, "back": back}
    rows.append({"part": part, "step": None, "n": 0, "edge": edge})
    kind = pa.struct([(n, pa.int64()) for n in edge])
    schema = pa.schema([("part", pa.int32()), ("step", pa.int64()), ("n", pa.int64()), ("edge", kind)])
    yield pa.RecordBatch.from_pylist(rows, schema)


def _combined(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Equal positions of a batch as one row with their number."""
    keys = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grouped = pa.Table.from_batches([batch]).group_by(keys).aggregate([([], "count_all")])
            yield from grouped.rename_columns([*keys, "copies"]).combine_chunks().to_batches()

    return run


def _steps_in_row_order(df: DataFrame, date_column: str, order_by: Sequence[str]) -> DataFrame:
    """(step, n, low, high, back) of all rows in the order of ``order_by``, then the date.

    One range exchange on (keys, date) puts the rows in order.  A position that many
    rows share goes there as one row a batch, so a hot one is no task of its own.
    """
    keys = [ref(c).alias(f"k{i}") for i, c in enumerate(order_by)]
    at = [*[f"k{i}" for i in range(len(keys))], "t"]
    positions = df.select(*keys, micros(date_of(df, date_column)).alias("t")).where(F.col("t").isNotNull())
    counted = T.StructType([*positions.schema.fields, T.StructField("copies", T.LongType())])
    rows = positions.mapInArrow(_combined(positions.schema), counted)
    folded = stage(
        rows.repartitionByRange(*at).sortWithinPartitions(*at).select("t", "copies").mapInArrow(_fold, FOLDED),
        "day-steps",
    )
    # One row per partition from here on.
    edges = folded.where(F.col("edge").isNotNull()).select("part", "edge.*")
    before = F.lag("last").over(Window.orderBy("part"))
    joined = edges.withColumn("delta", F.col("first") - before)
    ends = joined.select(
        _whole_days(F.col("delta")).alias("step"),
        F.lit(1).cast("bigint").alias("n"),
        "low",
        "high",
        (F.col("back") + F.coalesce((F.col("delta") < 0).cast("bigint"), F.lit(0))).alias("back"),
    )
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("low", "high", "back")]
    return folded.where(F.col("step").isNotNull()).select("step", "n", *nothing).unionByName(ends)


def _steps_in_date_order(df: DataFrame, date_column: str) -> DataFrame:
    """(step, n, low, high, back) of all rows in the order of the date itself.

    Rows are combined by day, map-side first; the steps within a day are zeros.  The days
    are put in order in one task: the calendar bounds their number, not the table.
    """
    instants = df.select(micros(date_of(df, date_column)).alias("t")).where(F.col("t").isNotNull())
    days = instants.groupBy(_whole_days(F.col("t")).alias("day")).agg(
        F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")
    )
    before = F.lag("last").over(Window.orderBy("day"))
    placed = days.withColumn("delta", F.col("first") - before)
    pairs = F.array(
        F.struct(F.lit(0).cast("bigint").alias("step"), (F.col("n") - 1).alias("n")),
        F.struct(_whole_days(F.col("delta")).alias("step"), F.lit(1).cast("bigint").alias("n")),
    )
    return placed.select(
        F.inline(pairs), F.col("first").alias("low"), F.col("last").alias("high"), F.lit(0).cast("bigint").alias("back")
    )


def _whole_days(delta: Column) -> Column:
    """Whole days, rounded down: half a day back is -1."""
    return F.floor(delta / F.lit(MICROS_PER_DAY)).cast("bigint")


def time_series_structure(
    df: DataFrame, date_column: str, order_by: Sequence[str] = ()
) -> DataFrame:
    """One row: column, sorted flag, frequency, modal step, first and last day.

    Empty when fewer than two dates parse.  Without ``order_by`` the rows are
    taken in date order and the sorted flag is NULL, as Spark has no file order.
    """
    steps = _steps_in_row_order(df, date_column, order_by) if order_by else _steps_in_date_order(df, date_column)
    by_step = steps.groupBy("step").agg(
        F.sum("n").alias("n"), F.min("low").alias("t_min"), F.max("high").alias("t_max"), F.sum("back").alias("back")
    )
    # A partition's or the table's first row has no step.
    seen = F.col("step").isNotNull() & (F.col("n") > 0)
    facts = by_step.agg(
        F.min("t_min").alias("t_min"),
        F.max("t_max").alias("t_max"),
        F.sum("back").alias("back"),
        F.min_by("step", F.when(seen, F.struct((-F.col("n")).alias("n"), F.col("step")))).alias("modal_step"),
    ).where(F.col("modal_step").isNotNull())
    in_order = F.col("back") == 0 if order_by else F.lit(None).cast("boolean")
    return facts.select(
        F.lit(date_column).alias("date_column"),
        in_order.alias("is_chronologically_sorted"),
        frequency_label(F.col("modal_step")).alias("estimated_frequency"),
        "modal_step",
        iso_day(day_of(F.col("t_min"))).alias("min_date"),
        iso_day(day_of(F.col("t_max"))).alias("max_date"),
    )
