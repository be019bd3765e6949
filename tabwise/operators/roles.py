"""Column roles and tags: expressions over the column profile.

Inputs and outputs here have one row per column of the analysed table, so
their size follows the schema and never the data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.functions import keywords as kw
from tabwise.functions.columns import NUMERIC_KINDS, contains_any, kinds
from tabwise.functions.dates import DATE_SHARE

ID_RATIO = 0.8
KEY_RATIO = 0.95
TEXT_LENGTH = 20
TEXT_DISTINCT = 10
TEXT_RATIO = 0.5
FRACTION_MAX = 1.05
PERCENT_MAX = 105
PERCENT_MIN_TOP = 1.5


# Types, titles and descriptions of the chart candidates.
CHART_KINDS = {
    "trend": "line", "bar": "bar", "pie": "pie", "scatter": "scatter", "correlation_heatmap": "heatmap",
}
CHART_TEXTS = {
    "trend": ("{y} Trend Over Time", "Analysis of {y} trends chronologically across {x}."),
    "bar": ("Total {y} by {x}", "Comparison of cumulative {y} performance across {x} segments."),
    "pie": ("Distribution by {x}", "Segment share breakdown for {x} categories."),
    "scatter": ("{x} vs {y} Correlation", "Statistical dispersion mapping of {x} against {y}."),
    "correlation_heatmap": (
        "Variable Correlation Matrix",
        "Pearson correlation coefficient heatmap showing relationships between all numeric variables.",
    ),
}


def _kind_in(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _date_like() -> Column:
    return _kind_in("string") & (F.coalesce("date_like_ratio", F.lit(0.0)) >= DATE_SHARE)


def role(nullable_ints_are_floats: bool = False) -> Column:
    """Six-way role, first match wins; a native date is always a Date."""
    name = F.lower("column")
    ratio, distinct = F.col("unique_ratio"), F.col("distinct")
    is_float = _kind_in("float")
    if nullable_ints_are_floats:
        is_float = is_float | (_kind_in("int") & (F.col("nulls") > 0))
    id_named = contains_any(F.col("column"), kw.ID_WORDS) | name.isin(*kw.ID_EXACT)
    unique_enough = (ratio > ID_RATIO) | _kind_in("string") | name.isin(*kw.ID_EXACT_LOW_RATIO)
    is_boolean = _kind_in("bool") | ((distinct == 2) & F.col("any_bool_token"))
    date_named = contains_any(F.col("column"), kw.DATE_ROLE_WORDS)
    is_text = (
        _kind_in("string")
        & (F.coalesce("avg_len", F.lit(0.0)) > TEXT_LENGTH)
        & ((distinct > TEXT_DISTINCT) | (ratio > TEXT_RATIO))
    )
    return (
        F.when(_kind_in("nested"), "Categorical")
        .when(_kind_in("date"), "Date")
        .when(id_named & unique_enough & ~is_float, "Identifier")
        .when(is_boolean, "Boolean")
        .when(date_named | _date_like(), "Date")
        .when(_kind_in(*NUMERIC_KINDS), "Numerical")
        .when(is_text, "Text")
        .otherwise("Categorical")
    )


def assign_roles(
    profile: DataFrame,
    nullable_ints_are_floats: bool = False,
    target_words: Sequence[str] = kw.TARGET_WORDS,
    currency_words: Sequence[str] = kw.CURRENCY_WORDS,
    percentage_words: Sequence[str] = kw.PERCENTAGE_WORDS,
    geo_words: Sequence[str] = kw.GEO_WORDS,
) -> DataFrame:
    """The column profile with ``role`` and the tag columns."""
    name = F.col("column")
    low, high = F.col("min_num"), F.col("max_num")
    is_date = (
        _kind_in("date")
        | (contains_any(name, kw.DATE_LIST_WORDS) & ~contains_any(name, kw.NOT_DATE_WORDS))
        | _date_like()
    )
    id_named = contains_any(name, kw.ID_WORDS)
    is_key = id_named & (F.col("unique_ratio") > KEY_RATIO) & (F.col("distinct") > 1)
    in_range = (low >= 0) & (
        (high <= FRACTION_MAX) | ((high <= PERCENT_MAX) & (high > PERCENT_MIN_TOP))
    )
    tagged = profile.withColumn("role", role(nullable_ints_are_floats)).withColumn(
        "is_date", is_date
    )
    numeric = ~F.col("is_date") & _kind_in(*NUMERIC_KINDS)
    tagged = tagged.withColumn("is_numeric", numeric).withColumn(
        "is_categorical", ~F.col("is_date") & ~F.col("is_numeric")
    )
    return tagged.withColumns(
        {
            "is_primary_key": is_key,
            "is_foreign_key": id_named & ~is_key,
            "is_currency": contains_any(name, currency_words) & F.col("is_numeric"),
            "is_percentage": contains_any(name, percentage_words)
            & F.col("is_numeric")
            & F.coalesce(in_range, F.lit(False)),
            "is_geo": contains_any(name, geo_words),
            "is_target": contains_any(name, target_words) if target_words else F.lit(False),
        }
    )


def bi_mapping(columns: DataFrame) -> DataFrame:
    """(concept, column) for six reporting concepts."""
    name = F.col("column")
    concepts = {
        "metrics": F.col("is_currency")
        | F.col("is_percentage")
        | (F.col("is_numeric") & ~F.col("is_primary_key")),
        "dimensions": F.col("is_categorical") & ~F.col("is_geo") & ~F.col("is_target"),
        "date_columns": F.col("is_date"),
        "geographic_columns": F.col("is_geo"),
        "financial_columns": F.col("is_currency"),
        "customer_columns": F.col("is_target") | contains_any(name, kw.CUSTOMER_WORDS),
    }
    matched = F.array_compact(
        F.array(*[F.when(test, F.lit(concept)) for concept, test in concepts.items()])
    )
    return columns.select(F.explode(matched).alias("concept"), "column")


def relationships(columns: DataFrame) -> DataFrame:
    """Every Date, Categorical or Boolean x with every Numerical y."""
    measures = columns.agg(
        F.collect_list(
            F.when(
                F.col("role") == "Numerical",
                F.struct(F.col("column").alias("y_col"), F.col("role").alias("y_type")),
            )
        ).alias("measures")
    )
    return (
        columns.where(F.col("role").isin("Date", "Categorical", "Boolean"))
        .withColumn("y", F.explode(measures.scalar()))
        .select(
            F.col("column").alias("x_col"),
            F.col("y.y_col").alias("y_col"),
            F.col("role").alias("x_type"),
            F.col("y.y_type").alias("y_type"),
            F.col("distinct").alias("unique_x_count"),
        )
    )


def schema_columns(df: DataFrame) -> DataFrame:
    """(pos, column, kind) of a table's columns, from its schema; no row is read."""
    rows = [(i, c, k) for i, (c, k) in enumerate(kinds(df).items())]
    return df.sparkSession.createDataFrame(rows, "pos int, column string, kind string")


def detect_domain(columns: DataFrame, mode: str = "substring") -> DataFrame:
    """One row: the business domain told by the column names.

    ``columns`` is a profile or, as only names count, ``schema_columns``.
    """
    if mode == "exact":
        table, default = kw.DOMAIN_EXACT, kw.DOMAIN_EXACT_DEFAULT
        tests = [(d, F.bool_or(F.lower("column").isin(*words))) for d, words in table]
    elif mode == "substring":
        table, default = kw.DOMAIN_WORDS, kw.DOMAIN_DEFAULT
        tests = [(d, F.bool_or(contains_any(F.col("column"), words))) for d, words in table]
    else:
        raise ValueError(f"unknown domain mode: {mode}")
    choice = F.coalesce(*[F.when(test, F.lit(domain)) for domain, test in tests], F.lit(default))
    return columns.agg(choice.alias("domain"))


def chart_candidates(columns: DataFrame, limit: int = 4) -> DataFrame:
    """(pos, chart_id, chart_type, x_col, y_col, title, description): the first charts worth drawing."""

    def named(role_name: str) -> Column:
        of_role = F.when(
            F.col("role") == role_name, F.struct("pos", "column", F.col("distinct"))
        )
        return F.sort_array(F.collect_list(of_role))

    lists = columns.agg(
        named("Date").alias("dates"),
        named("Numerical").alias("numerics"),
        named("Categorical").alias("categoricals"),
        named("Boolean").alias("booleans"),
    )

    def chart(chart_id: Column, kind: str, x: Column | None, y: Column | None) -> Column:
        nothing = F.lit(None).cast("string")
        x, y = (nothing if c is None else c for c in (x, y))
        names = {"x": F.coalesce(x, F.lit("")), "y": F.coalesce(y, F.lit(""))}

        def worded(text: str) -> Column:
            parts = re.split(r"\{(x|y)\}", text)  # every second part is a name
            return F.concat(*[names[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])

        return F.struct(
            chart_id.alias("chart_id"),
            F.lit(CHART_KINDS[kind]).alias("chart_type"),
            x.alias("x_col"),
            y.alias("y_col"),
            *[worded(t).alias(n) for n, t in zip(("title", "description"), CHART_TEXTS[kind])],
        )

    def joined(*parts) -> Column:
        return F.concat_ws("_", *parts)

    def pairs(kind: str, xs: Column) -> Column:
        first_two = F.slice("numerics", 1, 2)
        return F.flatten(
            F.transform(
                xs,
                lambda x: F.transform(
                    first_two,
                    lambda y: chart(
                        joined(F.lit(kind), x["column"], y["column"]),
                        kind,
                        x["column"],
                        y["column"],
                    ),
                ),
            )
        )

    segments = F.slice(F.concat("categoricals", "booleans"), 1, 2)
    pies = F.transform(
        F.filter(segments, lambda x: x["distinct"].between(2, 10)),
        lambda x: chart(joined(F.lit("pie"), x["column"]), "pie", x["column"], None),
    )
    first, second = (F.get("numerics", i)["column"] for i in (0, 1))
    none = F.slice(pies, 1, 0)
    scatter = F.when(
        F.size("numerics") >= 2,
        F.array(chart(joined(F.lit("scatter"), first, second), "scatter", first, second)),
    ).otherwise(none)
    heatmap = F.when(
        F.size("numerics") >= 3,
        F.array(chart(F.lit("correlation_heatmap"), "correlation_heatmap", None, None)),
    ).otherwise(none)
    all_charts = F.concat(
        pairs("trend", F.col("dates")),
        pairs("bar", F.slice("categoricals", 1, 2)),
        pies,
        scatter,
        heatmap,
    )
    return lists.select(F.posexplode(F.slice(all_charts, 1, limit)).alias("pos", "chart")).select(
        "pos", "chart.*"
    )
