"""KPIs: domain sets, free specifications, the scorecard table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.functions import display
from tabwise.functions.columns import NUMERIC_KINDS, exact_mean, exact_total, first_with_word, kinds, ref
from tabwise.functions.kpi_tables import (
    DOMAIN_KPIS,
    FIRST,
    LAST,
    SPEC_SETS,
    DomainKpi,
    KpiSpec,
    choose_set,
)


class _Measure(NamedTuple):
    title: str
    aggregate: Column
    show: Callable[[Column], Column]
    description: str
    read: Callable[[Column], Column] = lambda value: value


def _evaluate(df: DataFrame, measures: Sequence[_Measure]) -> DataFrame:
    """(pos, title, value, display, description): all measures in one aggregate."""
    return _rows(df.agg(*[m.aggregate.alias(f"m{i}") for i, m in enumerate(measures)]), measures)


def _rows(wide: DataFrame, measures: Sequence[_Measure]) -> DataFrame:
    """Display is of the sum in its own type; ``value`` is a double."""
    rows = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(m.title).alias("title"),
            m.read(F.col(f"m{i}")).cast("double").alias("value"),
            m.show(F.col(f"m{i}")).alias("display"),
            F.lit(m.description).alias("description"),
        )
        for i, m in enumerate(measures)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _constant(value: float | None) -> Column:
    return F.max(F.lit(value).cast("double"))


def truthy_rate(column: str, tokens: Sequence[str]) -> Column:
    """Percent of all rows whose lower-cased text is one of the tokens."""
    hits = F.count_if(F.lower(ref(column).cast("string")).isin(*tokens))
    return F.coalesce(F.try_divide(hits, F.count("*")) * 100, F.lit(0.0))


def _domain_measure(
    df: DataFrame, kpi: DomainKpi, numerics: Sequence[str], flags: Sequence[str], score: int
) -> _Measure:
    pool = flags if kpi.measure == "rate" else numerics
    column = first_with_word(pool, kpi.column_words) if kpi.column_words else None
    if column is None and kpi.measure in ("sum", "mean") and numerics:
        column = numerics[0]
    show = display.BY_NAME[kpi.display]
    if kpi.measure == "rows" or (kpi.measure == "volume" and column is None):
        aggregate, show = F.count("*"), display.count
    elif kpi.measure == "score":
        aggregate = _constant(score)
    elif column is None:
        aggregate = _constant(0.0)
    elif kpi.measure == "rate":
        aggregate = truthy_rate(column, kpi.tokens)
    elif kpi.measure == "mean":
        aggregate = exact_mean(df, column)
    else:
        aggregate = exact_total(df, column)
        if kpi.measure == "volume":
            show = display.count if kinds(df)[column] == "int" else display.every_digit
    return _Measure(kpi.title, aggregate, show, kpi.description.format(column=column or "N/A"))


def domain_kpis(
    df: DataFrame,
    domain: str,
    numerics: Sequence[str],
    flags: Sequence[str] = (),
    quality_score: int = 100,
) -> DataFrame:
    """The three KPIs of a domain, in one aggregate.

    ``numerics`` are the Numerical columns, ``flags`` the Boolean and then the
    Categorical ones, each in table order.
    """
    return _evaluate(df, _domain_measures(df, domain, numerics, flags, quality_score))


def _domain_measures(
    df: DataFrame, domain: str, numerics: Sequence[str], flags: Sequence[str], quality_score: int
) -> list[_Measure]:
    return [
        _domain_measure(df, kpi, numerics, flags, quality_score)
        for kpi in choose_set(DOMAIN_KPIS, domain)
    ]


class DomainKpis:
    """A domain's KPIs in two steps: aggregates to carry along in some pass over the rows,
    then the KPI rows from their values."""

    def __init__(
        self,
        df: DataFrame,
        domain: str,
        numerics: Sequence[str],
        flags: Sequence[str] = (),
        quality_score: int = 100,
    ) -> None:
        self._measures = _domain_measures(df, domain, numerics, flags, quality_score)
        self.aggregates = {f"m{i}": m.aggregate for i, m in enumerate(self._measures)}
        self._schema = df.agg(*[a.alias(n) for n, a in self.aggregates.items()]).schema
        self._spark = df.sparkSession

    def rows(self, values: Mapping[str, Any]) -> DataFrame:
        wide = self._spark.createDataFrame([tuple(values[n] for n in self.aggregates)], self._schema)
        return _rows(wide, self._measures)


def default_kpi_specs(columns: Sequence[str], domain: str) -> list[KpiSpec]:
    """Three specifications for a domain, on the columns they are named after."""
    place = {FIRST: columns[0], LAST: columns[-1]}

    def resolved(spec: KpiSpec) -> KpiSpec:
        column = place.get(spec.column, spec.column)
        if column not in columns:
            column = place[spec.fallback]
        return spec._replace(column=column, fallback=None)

    return [resolved(s) for s in choose_set(SPEC_SETS, domain)]


def evaluate_kpis(
    df: DataFrame, specs: Sequence[KpiSpec], flag_column: str = "Attrition", flag_value: str = "Yes"
) -> DataFrame:
    """Evaluate all specifications in one pass; ``N/A`` where one does not apply.

    COUNT counts rows, except on ``flag_column``, where it counts ``flag_value`` if that
    value occurs, and shows it without separators.  Sums and means take booleans as 0 and
    1, and add whole numbers and decimals in their own type.
    """
    found = kinds(df)

    def measure(spec: KpiSpec) -> _Measure:
        kind = found.get(spec.column)
        if kind is not None and spec.formula == "COUNT":
            if spec.column == flag_column and kind == "string":
                hits = F.count_if(ref(spec.column) == flag_value)
                # Negative where no flag was found, so that its display can tell.
                aggregate = F.when(hits > 0, hits).otherwise(-F.count("*"))
                return _Measure(spec.title, aggregate, display.flag_count, spec.description, F.abs)
            return _Measure(spec.title, F.count("*"), display.count, spec.description)
        if kind not in (*NUMERIC_KINDS, "bool"):
            return _Measure(spec.title, _constant(None), lambda v: F.lit("N/A"), spec.description)
        if spec.formula == "SUM":
            return _Measure(spec.title, exact_total(df, spec.column), display.money, spec.description)
        mean = exact_mean(df, spec.column)
        show = display.money if spec.formula == "AVERAGE" else display.two_decimals
        return _Measure(spec.title, mean, show, spec.description)

    return _evaluate(df, [measure(s) for s in specs])


def kpi_scorecard(kpis: DataFrame) -> DataFrame:
    """The KPI table of the report: metric, value, description."""
    return kpis.select(
        "pos",
        F.col("title").alias("kpi_metric"),
        F.coalesce("display", F.lit("N/A")).alias("value"),
        F.col("description").alias("strategic_description"),
    )
