"""KPI definitions as data."""

from __future__ import annotations

from typing import NamedTuple

from tabwise.functions import keywords as kw


class DomainKpi(NamedTuple):
    title: str
    measure: str  # rows | sum | mean | volume | rate | score
    column_words: tuple[str, ...]  # chooses the column by name
    tokens: tuple[str, ...]  # values counted by a rate
    display: str  # money | number | count | percent | score
    description: str  # "{column}" is the chosen column


class KpiSpec(NamedTuple):
    """A KPI by formula: SUM, AVERAGE, COUNT; anything else is a mean.

    ``column`` may be a position: FIRST or LAST column of the table.
    """

    title: str
    column: str | None
    formula: str
    description: str = ""
    fallback: str | None = None


FIRST, LAST = "<first>", "<last>"

# KPI sets by words in the domain label (first match wins), with
# their titles and descriptions; the last set has no words and always matches.
DOMAIN_KPIS: tuple[tuple[tuple[str, ...], tuple[DomainKpi, ...]], ...] = (
    (
        ("sales", "revenue"),
        (
            DomainKpi("Total Revenue", "sum", kw.KPI_REVENUE_WORDS, (), "money",
                      "Cumulative revenue from {column} column"),
            DomainKpi("Total Volume", "volume", kw.KPI_VOLUME_WORDS, (), "number",
                      "Sum of transaction items/records"),
            DomainKpi("Average Ticket Size", "mean", kw.KPI_REVENUE_WORDS, (), "money",
                      "Average transaction value"),
        ),
    ),
    (
        ("human", "hr"),
        (
            DomainKpi("Total Headcount", "rows", (), (), "count",
                      "Active employee database record count"),
            DomainKpi("Attrition Rate", "rate", kw.KPI_HR_FLAG_WORDS, kw.HR_TRUTHY, "percent",
                      "Percentage of employees left based on {column}"),
            DomainKpi("Average Monthly Income", "mean", kw.KPI_HR_PAY_WORDS, (), "money",
                      "Average base monthly salary"),
        ),
    ),
    (
        ("churn", "customer"),
        (
            DomainKpi("Total Customer Pool", "rows", (), (), "count", "Subscriber record count"),
            DomainKpi("Customer Churn Rate", "rate", kw.KPI_CHURN_FLAG_WORDS, kw.CHURN_TRUTHY,
                      "percent", "Percentage of subscribers churned based on {column}"),
            DomainKpi("Avg Monthly Charges", "mean", kw.KPI_CHURN_CHARGE_WORDS, (), "money",
                      "Average monthly billing per customer"),
        ),
    ),
    (
        (),
        (
            DomainKpi("Total Row Count", "rows", (), (), "count", "Total observations scanned"),
            DomainKpi("Average Value", "mean", (), (), "number", "Average of {column}"),
            DomainKpi("Data Integrity Score", "score", (), (), "score",
                      "Deduplication and rule validations score"),
        ),
    ),
)

# Default specifications by words in the domain label.
SPEC_SETS: tuple[tuple[tuple[str, ...], tuple[KpiSpec, ...]], ...] = (
    (
        ("hr", "employee"),
        (
            KpiSpec("Total Employees", FIRST, "COUNT", "Total active workforce census count."),
            KpiSpec("Average Monthly Income", "MonthlyIncome", "AVERAGE",
                    "Average salary across all active workers.", LAST),
            KpiSpec("Attrition Count", "Attrition", "COUNT", "Total employee turnover volume.",
                    FIRST),
        ),
    ),
    (
        (),
        (
            KpiSpec("Total Gross Sales", "Amount", "SUM",
                    "Cumulative total billing revenue across segments.", LAST),
            KpiSpec("Average Transaction Value", "Amount", "AVERAGE",
                    "Mean value generated per billing invoice.", LAST),
            KpiSpec("Total Order Volume", FIRST, "COUNT",
                    "Aggregate volume of invoices processed."),
        ),
    ),
)


def choose_set(sets, domain: str):
    label = domain.lower()
    return next(s for words, s in sets if not words or any(w in label for w in words))
