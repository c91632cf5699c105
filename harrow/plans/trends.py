"""Yearly counts, shares and over-representation."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.strings import before_dot, blank_to, squeeze_upper
from harrow.operators import aggregates, filters, joins


def yearly_counts(
    df: DataFrame, date: str, units: Mapping[str, str], conditions: Mapping[str, Column], first: int, last: int
) -> DataFrame:
    """Long table (year, variable, value): distinct units, plain and under each condition."""
    kept = df.where(filters.in_years(date, first, last)).withColumn("year", F.year(date))
    long = []
    for name, unit in units.items():
        counts = {f"unique_{name}": None} | {f"unique_{name}_with_{label}": c for label, c in conditions.items()}
        long.append(aggregates.lengthen(aggregates.distinct_counts(kept, ["year"], unit, counts), ["year"], list(counts)))
    return reduce(DataFrame.unionByName, long)


def agent_representation(df: DataFrame, agent: str, unit: str, condition: Column) -> DataFrame:
    """Share of each agent's distinct units that meet a condition, highest first."""
    named = df.withColumn("agent", blank_to(squeeze_upper(F.coalesce(F.col(agent), F.lit(""))), "Missing"))
    return joins.grouped_share(named, ["agent"], unit, condition).orderBy(F.desc("share"), "agent")


def consolidated_titles(df: DataFrame, code: str, title: str) -> DataFrame:
    """Most frequent title(s) of each code, the code cut at its dot."""
    cut = df.withColumn("code", before_dot(F.col(code)))
    return filters.most_frequent_per_group(cut, "code", title, "count_titles")
