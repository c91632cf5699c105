"""Staffing panel: quarters, trailing means, per-unit ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.dates import quarter_index
from harrow.operators import aggregates, joins


def with_trailing_mean(
    facts: DataFrame, staff: DataFrame, keys: Sequence[str], value: str, out: str, quarters: int = 4
) -> DataFrame:
    """Mean staff over the quarters before each fact's own quarter.

    Each staff row is put under the quarters it counts for (one row each), so
    the lookup is a plain equality join on key and quarter index.
    """
    own = quarter_index(F.col("year"), F.col("quarter"))
    lagged = staff.select(
        *keys, F.col(value).alias("_value"), F.explode(F.sequence(own + 1, own + quarters)).alias("quarter_index")
    )
    means = lagged.groupBy(*keys, "quarter_index").agg(F.bround(F.avg("_value")).alias(out))
    indexed = facts.withColumn("quarter_index", quarter_index(F.col("year"), F.col("quarter")))
    return indexed.join(means, [*keys, "quarter_index"], "left")


def staff_by_quarter(facts: DataFrame, keys: Sequence[str], count: str, pay: str, first: int, last: int) -> DataFrame:
    """Headcount and mean pay per key and quarter on the complete grid, zero where none."""
    summed = aggregates.sums_and_means(facts, [*keys, "year", "quarter"], [count], [pay])
    grid = joins.quarter_grid(facts.select(*keys), first, last)
    return joins.complete_counts(summed, grid, [*keys, "year", "quarter"], [f"sum_{count}", f"mean_{pay}"])


def yearly_panel(cases: DataFrame, keys: Sequence[str], amount: str, violations: str, staff: str) -> DataFrame:
    """Per key and year: mean amount over summed violations, and summed staff."""
    grouped = cases.groupBy(*keys, "year").agg(
        F.avg(amount).alias("mean_amount"), F.sum(violations).alias("sum_violations"), F.sum(staff).alias("staff")
    )
    return grouped.withColumn("amount_per_violation", F.try_divide(F.col("mean_amount"), F.col("sum_violations")))
