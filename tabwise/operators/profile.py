"""Table and column statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions import keywords as kw
from tabwise.functions.columns import (
    NUMERIC_KINDS,
    aggregate_long,
    by_position,
    entries_per_row,
    exact_total,
    has_word,
    kind_of,
    kinds,
    number_of,
    numeric_columns,
    ref,
    value_of,
)
from tabwise.functions.dates import looks_like_date, micros
from tabwise.operators.quantiles import Spread, bracket, exact_medians

# Texts longer than this are compared by digest, so a shuffle moves 64
# characters and not a document.
DIGEST_ABOVE = 64

# Counts near these values decide a role; fast mode recounts them exactly.
BOOLEAN_COUNT, FEW_COUNT = 2, 10
TEXT_RATIO, KEY_RATIOS = 0.5, (0.8, 0.95)
# No longer text has the shape of a date, so none is carried along.
LONGEST_DATE = 10
# Binary logarithm of a distinct-count sketch's registers: it is off by 1.6 % in two
# thirds of cases, and by the band hardly ever.
LOG_REGISTERS = 12
FAST_BAND = 0.1


# --- one value per row -------------------------------------------------------


def _as_text(df: DataFrame, name: str) -> Column:
    """Text that is equal exactly where non-numeric values are equal."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.BinaryType):
        return F.hex(ref(name))
    if kind_of(data_type) == "nested":
        return F.to_json(F.struct(ref(name).alias("v")))
    return ref(name).cast("string")


def _comparable_text(df: DataFrame, name: str) -> Column:
    text = _as_text(df, name)
    # A digest is one character longer than any text kept as it is, so none equals another's text.
    digest = F.concat(F.lit("#"), F.sha2(text, 256))
    return F.when(F.length(text) > DIGEST_ABOVE, digest).otherwise(text)


def hashable(df: DataFrame, name: str) -> Column:
    return _as_text(df, name) if kind_of(df.schema[name].dataType) == "nested" else value_of(df, name)


def row_fingerprint(df: DataFrame) -> Column:
    """128-bit digest of a whole row; equal rows (NULLs equal) share it.

    Two 64-bit hashes over the columns in opposite orders.  Hashes skip NULLs,
    so both also take in which columns are NULL.  Among 10^12 different rows the
    chance that any two share a digest is below 10^-14.
    """
    gaps = F.concat(*[F.when(value_of(df, c).isNull(), "0").otherwise("1") for c in df.columns])
    values = [hashable(df, c) for c in df.columns]
    return F.struct(
        F.xxhash64(gaps, *values).alias("forward"),
        F.xxhash64(*reversed(values), gaps).alias("backward"),
    )


# --- table level -------------------------------------------------------------


def _null_total(df: DataFrame) -> Column:
    """Nulls in a row, summed over its columns."""
    flags = [value_of(df, c).isNull().cast("bigint") for c in df.columns]
    total = flags[0]
    for flag in flags[1:]:
        total = total + flag
    return total


def table_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, total nulls, duplicates, quality score.

    Rows are reduced to digests before the shuffle and counted per digest, so
    the duplicates of one hot row collapse map-side; nulls ride along in the
    same pass.
    """
    per_digest = (
        df.select(row_fingerprint(df).alias("digest"), _null_total(df).alias("nulls"))
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.sum("nulls").alias("nulls"))
    )
    summary = per_digest.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.coalesce(F.sum("nulls"), F.lit(0)).cast("bigint").alias("total_nulls"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"),
    )
    return summary.withColumn(
        "quality_score",
        score_of("row_count", "column_count", "total_nulls", "duplicate_count"),
    )


def score_of(rows: str, columns: str, nulls: str, duplicates: str) -> Column:
    """100 minus weighted missing and duplicate shares, truncated, within 50..100."""
    missing = F.try_divide(F.col(nulls), F.col(rows) * F.col(columns))
    repeated = F.try_divide(F.col(duplicates), F.col(rows))
    loss = F.coalesce(missing * 40 + repeated * 30, F.lit(0.0)).cast("int")
    return F.greatest(F.lit(50), F.least(F.lit(100), F.lit(100) - loss)).cast("int")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("row_count"), F.lit(len(df.columns)).alias("column_count")
    )


def quality_score(df: DataFrame) -> DataFrame:
    return table_summary(df).select("quality_score")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows after the first of each set of equal rows."""
    per_digest = df.groupBy(row_fingerprint(df).alias("digest")).agg(F.count("*").alias("n"))
    return per_digest.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count")
    )


# --- column level ------------------------------------------------------------


def null_counts(df: DataFrame) -> DataFrame:
    return aggregate_long(
        df,
        "column",
        [(c, {"nulls": F.count_if(value_of(df, c).isNull())}) for c in df.columns],
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct): exact, NULL not counted.

    Cells become (column, value) pairs that are combined map-side; only the
    distinct pairs of a task reach the shuffle, spread by column and value.
    Whole numbers, fractions and texts are counted apart, each in its own type.
    """
    columns = list(columns if columns is not None else df.columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, distinct bigint")
    by_slot: dict[str, dict[str, Column]] = {}
    for c in columns:
        slot, value = _slot_of(df, c)
        by_slot.setdefault(slot, {})[c] = value
    parts = []
    for group in by_slot.values():
        cells = entries_per_row(df, [{"value": v} for v in group.values()])
        parts.append(
            cells.dropDuplicates()
            .groupBy("position")
            .agg(F.count("value").alias("distinct"))
            .select(by_position(list(group)).alias("column"), "distinct")
        )
    return reduce(DataFrame.unionByName, parts)


def _slot_of(df: DataFrame, name: str) -> tuple[str, Column]:
    data_type = df.schema[name].dataType
    kind = kind_of(data_type)
    if kind == "bool" or isinstance(data_type, T.IntegralType):
        return "whole", ref(name).cast("bigint")
    if isinstance(data_type, T.DateType):
        return "whole", F.unix_date(ref(name)).cast("bigint")
    if isinstance(data_type, T.TimestampType):
        return "whole", F.unix_micros(ref(name))
    if isinstance(data_type, T.TimestampNTZType):
        return "whole", micros(ref(name))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return "fraction", value_of(df, name).cast("double")
    return "words", _comparable_text(df, name)


def numeric_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Mean, min, max, median of every numeric column; no rows without one."""
    columns = numeric_columns(df)
    schema = "column string, mean double, min_num double, max_num double, median double"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)

    def stats(c: str) -> dict[str, Column]:
        number = number_of(df, c)
        found = {
            "mean": F.avg(number), "min_num": F.min(number), "max_num": F.max(number),
            "n": F.count(number), "bracket": bracket(number),
        }
        return found if exact else found | {"median": F.percentile_approx(number, 0.5)}

    basic = aggregate_long(df, "column", [(c, stats(c)) for c in columns])
    if not exact:
        return basic.drop("n", "bracket")
    rows = basic.collect()
    middles = exact_medians(
        df, columns, {r["column"]: Spread(r["n"], r["min_num"], r["max_num"], r["bracket"]) for r in rows}
    )
    return df.sparkSession.createDataFrame(
        [(r["column"], r["mean"], r["min_num"], r["max_num"], middles[r["column"]]) for r in rows],
        schema,
    )


def string_lengths(df: DataFrame) -> DataFrame:
    columns = [c for c, k in kinds(df).items() if k == "string"]
    return aggregate_long(df, "column", [(c, {"avg_len": F.avg(F.length(ref(c)))}) for c in columns])


def date_likeness(df: DataFrame, sample: int | None = None) -> DataFrame:
    """Share of non-null values shaped like a date, per text column.

    Over all values; with ``sample``, over that many different values at most, drawn by
    hash: the values fall into as many parts and the one with the least digest speaks for
    its part.  So the draw depends on the values alone, and one aggregate of fixed size
    makes it for all columns.
    """
    columns = [c for c, k in kinds(df).items() if k == "string"]
    if sample is None:
        return aggregate_long(
            df, "column", [(c, {"date_like_ratio": _date_share(c)}) for c in columns]
        )
    drawn = aggregate_long(df, "column", [(c, _drawn_values(c, sample)) for c in columns])
    found = F.array_compact(F.array(*[F.col(f"part{i}") for i in range(sample)]))
    like = F.aggregate(found, F.lit(0), lambda n, v: n + looks_like_date(v["value"]).cast("int"))
    return drawn.select(
        "column", F.coalesce(F.try_divide(like, F.size(found)), F.lit(0.0)).alias("date_like_ratio")
    )


def _drawn_values(name: str, sample: int) -> dict[str, Column]:
    value = F.when(F.length(ref(name)) <= LONGEST_DATE, ref(name)).otherwise(F.lit(""))
    digest = F.md5(ref(name))
    part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % sample
    row = F.struct(digest.alias("digest"), value.alias("value"))
    return {
        f"part{i}": F.min(F.when(ref(name).isNotNull() & (part == i), row)) for i in range(sample)
    }


def _date_share(name: str) -> Column:
    return F.coalesce(F.avg(looks_like_date(ref(name)).cast("int")), F.lit(0.0))


def _any_token(name: str, kind: str) -> Column:
    """Whether any value reads as a boolean."""
    if kind == "int":
        hit = ref(name).isin(*[int(t) for t in kw.BOOLEAN_TOKENS if t.isdigit()])
    else:
        hit = F.lower(ref(name).cast("string")).isin(*kw.BOOLEAN_TOKENS)
    return F.bool_or(hit)


def _column_stats(df: DataFrame, name: str, kind: str) -> dict[str, Column]:
    """The aggregates a kind of column has; the others stay NULL."""
    stats = {"nulls": F.count_if(value_of(df, name).isNull())}
    if kind in NUMERIC_KINDS:
        number = number_of(df, name)
        stats |= {"mean": F.avg(number), "min_num": F.min(number), "max_num": F.max(number)}
    if kind == "string":
        stats |= {"avg_len": F.avg(F.length(ref(name))), "date_like_ratio": _date_share(name)}
    if kind in ("int", "bool", "string"):  # a float never reads as one: 1.0
        stats["any_bool_token"] = _any_token(name, kind)
    return stats


def distinct_sketch(df: DataFrame, name: str) -> Column:
    """A mergeable sketch of a column's different values, a few kilobytes whatever their number."""
    value = F.when(value_of(df, name).isNotNull(), F.xxhash64(hashable(df, name)))
    return F.hll_sketch_agg(value, LOG_REGISTERS)


def _sketches(df: DataFrame, name: str, kind: str, median: bool, counted: bool = True) -> dict[str, Column]:
    stats = {}
    if kind != "nested" and counted:
        stats["distinct"] = F.hll_sketch_estimate(distinct_sketch(df, name))
    if median and kind in NUMERIC_KINDS:
        stats["median"] = F.percentile_approx(number_of(df, name), 0.5)
    return stats


def _collect_stats(df: DataFrame, stats: dict[str, dict[str, Column]]) -> dict[str, dict]:
    """All statistics of all columns in one pass; one row comes back."""
    aggs = [
        agg.alias(f"{i}_{field}")
        for i, found in enumerate(stats.values())
        for field, agg in found.items()
    ]
    row = df.agg(F.count("*").alias("rows"), *aggs).first()
    return {
        name: {"rows": row["rows"], **{field: row[f"{i}_{field}"] for field in found}}
        for i, (name, found) in enumerate(stats.items())
    }


def column_profile(
    df: DataFrame, exact: bool = True, median: bool = True, counts: DataFrame | None = None
) -> DataFrame:
    """One row per column: kind, counts and statistics.

    Runs at once and holds its few rows as values, so that roles, rules and
    charts built on it do not profile again.  One wide aggregate first; exact
    mode adds the distinct counts and the median passes.  ``exact=False`` takes
    sketches in the wide aggregate instead and recounts only the columns whose
    count decides a role; a sketch that is off by more than ``FAST_BAND`` could still give
    a wrong one.  ``counts`` (column, distinct), as ``merged_counts`` gives them from stored
    sketches, take the place of sketches from this scan.  ``median=False`` leaves medians
    out; roles need none.
    """
    found = kinds(df)
    stored = {} if counts is None else {r["column"]: r["distinct"] for r in counts.select("column", "distinct").collect()}
    stats = {c: _column_stats(df, c, k) for c, k in found.items()}
    if exact and median:
        for c in numeric_columns(df):
            stats[c]["bracket"] = bracket(number_of(df, c))
    if not exact:
        for c, k in found.items():
            stats[c] |= _sketches(df, c, k, median, counted=c not in stored)
    facts = _collect_stats(df, stats)
    for c in stored.keys() & facts.keys() if not exact else ():
        facts[c]["distinct"] = stored[c]
    countable = [c for c, k in found.items() if k != "nested"]
    recount = countable if exact else [
        c for c in countable if _is_decisive(c, found[c], facts[c])
    ]
    if exact and median:
        numeric = numeric_columns(df)
        spread = {
            c: Spread(f["rows"] - f["nulls"], f["min_num"], f["max_num"], f["bracket"])
            for c, f in facts.items()
            if c in numeric
        }
        for c, middle in exact_medians(df, numeric, spread).items():
            facts[c]["median"] = middle
    for r in distinct_counts(df, recount).collect():
        facts[r["column"]]["distinct"] = r["distinct"]
    rows = []
    for pos, field in enumerate(df.schema.fields):
        fact = facts[field.name]
        distinct = fact.get("distinct") or 0
        described = fact | {
            "column": field.name,
            "pos": pos,
            "spark_type": field.dataType.simpleString(),
            "kind": found[field.name],
            "distinct": distinct,
            "unique_ratio": distinct / max(1, fact["rows"]),
            "any_bool_token": bool(fact.get("any_bool_token")),
        }
        rows.append(tuple(described.get(f) for f in PROFILE_SCHEMA))
    schema = ", ".join(f"{name} {type_name}" for name, type_name in PROFILE_SCHEMA.items())
    return df.sparkSession.createDataFrame(rows, schema)


PROFILE_SCHEMA = {
    "column": "string", "pos": "int", "spark_type": "string", "kind": "string", "rows": "bigint",
    "nulls": "bigint", "distinct": "bigint", "unique_ratio": "double", "mean": "double",
    "min_num": "double", "max_num": "double", "median": "double", "avg_len": "double",
    "date_like_ratio": "double", "any_bool_token": "boolean",
}


def _is_decisive(name: str, kind: str, stats: dict) -> bool:
    """Whether a sketched count lies near a count or ratio that decides a role or tag."""
    count, ratio = stats["distinct"], stats["distinct"] / max(1, stats["rows"])

    def near(value: float, limit: float, least: float = 0.0) -> bool:
        return abs(value - limit) <= max(least, limit * FAST_BAND)

    return (
        bool(stats.get("any_bool_token")) and near(count, BOOLEAN_COUNT, 1)
        or kind == "string" and (near(count, FEW_COUNT, 1) or near(ratio, TEXT_RATIO))
        or has_word(name, kw.ID_WORDS) and any(near(ratio, limit) for limit in KEY_RATIOS)
    )


# --- derived metrics ---------------------------------------------------------


# Names, formulas and reasons of the suggestions.
RATIO_METRIC = ("Cost-to-Revenue Ratio", "Cost / Revenue", "Financial performance ratio analysis.")
UNIT_METRIC = ("Average Unit Price", "{0} / Quantity", "Unit economics calculation.")


def derived_suggestions(columns: DataFrame) -> DataFrame:
    """(metric_name, formula, rationale): a ratio of two currency columns, a unit price."""
    facts = columns.agg(
        F.count_if("is_currency").alias("n"),
        F.min_by("column", F.when(F.col("is_currency"), F.col("pos"))).alias("first"),
        F.bool_or(F.col("column") == "Quantity").alias("has_quantity"),
    )

    def suggestion(texts: tuple[str, str, str]) -> Column:
        name, formula, reason = (F.lit(t) for t in texts)
        formula = F.replace(formula, F.lit("{0}"), F.coalesce("first", F.lit("")))
        return F.struct(name.alias("metric_name"), formula.alias("formula"), reason.alias("rationale"))

    return facts.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.col("n") >= 2, suggestion(RATIO_METRIC)),
                    F.when((F.col("n") >= 1) & F.col("has_quantity"), suggestion(UNIT_METRIC)),
                )
            )
        )
    )


def derived_totals(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """(metric_name, numerator, denominator, value): each ratio of the column totals.

    Totals are exact sums in one pass; NULL where the lower one is 0.
    """
    return aggregate_long(
        df,
        "metric_name",
        [
            (name, {side: exact_total(df, c).cast("double") for side, c in zip(("numerator", "denominator"), pair)})
            for name, pair in ratios.items()
        ],
    ).withColumn("value", F.try_divide("numerator", "denominator"))


def derived_metrics(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Add one column per ``{name: (numerator, denominator)}``; NULL where undefined."""
    return df.withColumns(
        {
            name: F.try_divide(number_of(df, top), number_of(df, bottom))
            for name, (top, bottom) in ratios.items()
        }
    )
