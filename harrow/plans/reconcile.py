"""Yearly files with drifting headers to one table, and a report of the drift."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.strings import join_names
from harrow.operators import schema


def reconcile_periods(
    periods: Mapping[str, DataFrame],
    shared_names: Mapping[str, str],
    own_names: Mapping[str, Mapping[str, str]] = {},
    person: tuple[str, tuple[str, str, str]] | None = None,
    source: str = "data_source",
    common_only: bool = True,
) -> DataFrame:
    """Rename, build the person name where its parts exist, label, and stack.

    ``common_only`` keeps the columns all periods share; otherwise absent
    columns are null.
    """
    renamed = schema.rename_periods(periods, shared_names, own_names)
    ready = []
    for label, table in renamed.items():
        if person and set(person[1]) <= set(table.columns):
            whole = join_names(*[F.col(c) for c in person[1]])
            table = table.withColumn(person[0], whole).drop(*person[1])
        ready.append(schema.with_source(table, label, source))
    return schema.stack_common(ready) if common_only else schema.stack(ready)


def drift_with_fill(periods: Mapping[str, DataFrame]) -> DataFrame:
    """Drift status of each period's columns with the number of filled cells."""
    parts = []
    shared = set(schema.common_columns([periods[p] for p in sorted(periods)]))
    fresh = set(schema.new_columns(periods))
    for period in sorted(periods):
        table = periods[period]
        filled = table.agg(*[F.count(c).alias(c) for c in table.columns])
        long = filled.unpivot([], table.columns, "column", "filled")
        status = {
            c: "common" if c in shared else "new" if (period, c) in fresh else "kept" for c in table.columns
        }
        label = F.create_map(*[F.lit(x) for pair in status.items() for x in pair])
        parts.append(long.select(F.lit(period).alias("period"), "column", label[F.col("column")].alias("status"), "filled"))
    return reduce(DataFrame.unionByName, parts)
