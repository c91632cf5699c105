"""Profiles of a table, monthly comparison, map layers, tidy lists, addenda."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.strings import strip_breaks, strip_dashes
from harrow.operators import aggregates, filters, groups, joins, spatial


def table_profile(df: DataFrame, numbers: Sequence[str], texts: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """(variable, statistic, value): moments, quartiles, distinct counts, nulls, date range as day numbers."""
    nulls = aggregates.null_counts(df.select(*numbers, *texts, *dates)).select(
        "variable", F.lit("nulls").alias("statistic"), F.col("nulls").cast("double").alias("value")
    )
    parts = [aggregates.describe(df, numbers, texts), nulls]
    for d in dates:
        span = aggregates.date_range(df, d).select(
            F.unix_date(F.to_date("first_date")).cast("double").alias("first_day"),
            F.unix_date(F.to_date("last_date")).cast("double").alias("last_day"),
        )
        parts.append(span.unpivot([], ["first_day", "last_day"], "statistic", "value").select(F.lit(d).alias("variable"), "statistic", "value"))
    return reduce(DataFrame.unionByName, parts)


def monthly_sources(sources: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(month, source, n): distinct ids per month and source on one calendar, zero where none.

    ``sources`` maps a name to (table, date column, id column).
    """
    dated = reduce(
        DataFrame.unionByName,
        [t.select(F.lit(name).alias("source"), F.col(d).alias("_date"), F.col(i).cast("string").alias("_id")) for name, (t, d, i) in sources.items()],
    )
    counts = dated.groupBy("source", F.trunc("_date", "month").alias("month")).agg(F.count_distinct("_id").alias("n"))
    labels = F.explode(F.array(*[F.lit(s) for s in sources])).alias("source")
    grid = joins.month_calendar(dated, "_date").select("month", labels)
    return joins.complete_counts(counts, grid, ["month", "source"], ["n"])


def map_layer(
    polygons: DataFrame, rings: str, area: str, values: DataFrame, value: str, row: str,
    first: DataFrame, second: DataFrame, names: tuple[str, str],
) -> DataFrame:
    """Per area: mean value over distinct rows, which sources saw it, and its centre."""
    means = aggregates.mean_of_distinct(values, [area], value, [row])
    category = groups.key_category(polygons, first, second, area, names)
    return spatial.with_centroid(polygons, rings).drop(rings).join(means, area, "left").join(category, area, "left")


def tidy_list(df: DataFrame, name: str, start: Column, end: Column, keep: Sequence[str] = ()) -> DataFrame:
    """A debarment list with one-line names and parsed dates, rows without a name or start left out."""
    clean = F.trim(strip_dashes(strip_breaks(F.col(name))))
    tidy = df.select(clean.alias("entity"), start.alias("start_date"), end.alias("end_date"), *keep)
    return filters.complete_rows(tidy, ["entity", "start_date"])[0]


def list_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    return groups.shared_keys(first, second, "entity", "entity", "entity")


def addenda(sections: DataFrame, case: str, order: str, text: str, facts: DataFrame, drop_words: Sequence[str]) -> DataFrame:
    """One text per case: repeated sections once, translations out, sections
    joined in order, with a flag for cases that have facts."""
    unique = aggregates.first_of_duplicates(sections, [case, text], [F.col(order).asc()])
    english = filters.without_marker_words(unique, text, drop_words)
    whole = aggregates.concat_text(english, case, text, [order])
    return joins.join_with_indicator(whole, facts.select(case).distinct(), [case], "found")
