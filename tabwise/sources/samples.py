"""Synthetic sample tables with planted gaps and one bad value each.

Draws are hashes of row number and seed: a seed gives the same table however
the rows are partitioned, and again after a lost task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories with weights, value ranges and planted row numbers.
SALES_CATEGORIES = (
    ("Electronics", 0.3), ("Apparel", 0.25), ("Furniture", 0.15), ("Office Supplies", 0.2),
    ("Software", 0.1),
)
SALES_REGIONS = ("North America", "Europe", "Asia-Pacific", "Latin America")
SALES_FIRST_DAY, SALES_DAYS = "2025-01-01", 120
SALES_AMOUNT = (50, 1200)
SALES_QUANTITY = (1, 10)
SALES_ROWS = 150
SALES_NULL_AMOUNT = (5, 10)
SALES_NULL_CATEGORY = (25, 27)
SALES_NEGATIVE_ROW, SALES_NEGATIVE = 12, -250.0

HR_DEPARTMENTS = (
    ("Sales", 0.25), ("Research & Development", 0.35), ("Human Resources", 0.1),
    ("Engineering", 0.2), ("Marketing", 0.1),
)
HR_AGE, HR_INCOME, HR_TENURE = (22, 60), (3000, 16000), (1, 15)
HR_LEFT_SHARE = 0.15
HR_ROWS = 120
HR_NULL_INCOME = (10, 13)
HR_NEGATIVE_ROW, HR_NEGATIVE_AGE = 45, -5


DRAWS = 1 << 40


def _draw(seed: int) -> Column:
    """Uniform in [0, 1), one per row."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(DRAWS)) / DRAWS


def _weighted(weights: Sequence[tuple[str, float]], draw: Column) -> Column:
    reached, choice = 0.0, None
    for name, weight in weights[:-1]:
        reached += weight
        test = draw < F.lit(reached)
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return choice.otherwise(weights[-1][0])


def _evenly(values: Sequence[str], draw: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (draw * len(values)).cast("int"))


def _whole(bounds: tuple[int, int], draw: Column) -> Column:
    low, high = bounds
    return (F.lit(low) + F.floor(draw * (high - low))).cast("int")


def _hidden(bounds: tuple[int, int], value: Column) -> Column:
    return F.when(~F.col("id").between(*bounds), value)


def sample_sales(spark: SparkSession, rows: int = SALES_ROWS, seed: int = 42) -> DataFrame:
    low, high = SALES_AMOUNT
    amount = F.round(F.lit(low) + _draw(seed + 3) * (high - low), 2)
    amount = F.when(F.col("id") == SALES_NEGATIVE_ROW, SALES_NEGATIVE).otherwise(
        _hidden(SALES_NULL_AMOUNT, amount)
    )
    day = F.date_add(F.lit(SALES_FIRST_DAY).cast("date"), (_draw(seed) * SALES_DAYS).cast("int"))
    return spark.range(rows).select(
        day.alias("Date"),
        _hidden(SALES_NULL_CATEGORY, _weighted(SALES_CATEGORIES, _draw(seed + 1))).alias(
            "Category"
        ),
        _evenly(SALES_REGIONS, _draw(seed + 2)).alias("Region"),
        amount.alias("Amount"),
        _whole(SALES_QUANTITY, _draw(seed + 4)).alias("Quantity"),
    )


def sample_hr(spark: SparkSession, rows: int = HR_ROWS, seed: int = 100) -> DataFrame:
    age = F.when(F.col("id") == HR_NEGATIVE_ROW, HR_NEGATIVE_AGE).otherwise(
        _whole(HR_AGE, _draw(seed))
    )
    return spark.range(rows).select(
        F.format_string("EMP%03d", F.col("id") + 1).alias("Employee_ID"),
        age.alias("Age"),
        _weighted(HR_DEPARTMENTS, _draw(seed + 1)).alias("Department"),
        _hidden(HR_NULL_INCOME, _whole(HR_INCOME, _draw(seed + 2)).cast("double")).alias(
            "MonthlyIncome"
        ),
        F.when(_draw(seed + 3) < HR_LEFT_SHARE, "Yes").otherwise("No").alias("Attrition"),
        _whole(HR_TENURE, _draw(seed + 4)).alias("Tenure"),
    )
