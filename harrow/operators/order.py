"""Positions, running totals, ranks and quantiles over data of any size.

A plain window puts a whole group into one task. Here rows are range
partitioned by (group, order), so one large group spreads over many slices;
each slice is scanned on its own and a small table of slice totals carries the
state across. Slices hold about equal numbers of rows whatever the group sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.session import cut_lineage

SLICE, PLACE = "_scan_slice", "_scan_place"


def _sorted_slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in range slices with slice number and place.

    The copy is written once: slice bounds come from sampling, so a recomputed
    plan could cut elsewhere.
    """
    by = [F.col(k) for k in keys] + list(order)
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by)
    laid = laid.select("*", F.spark_partition_id().alias(SLICE), F.monotonically_increasing_id().alias(PLACE))
    return cut_lineage(laid)


def _join_slices(df: DataFrame, per_slice: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = per_slice.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, SLICE]})
    match = df[SLICE] == renamed[f"_k_{SLICE}"]
    for k in keys:
        match = match & df[k].eqNullSafe(renamed[f"_k_{k}"])
    return df.join(renamed, match, "inner").drop(*[f"_k_{k}" for k in [*keys, SLICE]])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    amount: Column | None = None,
    out: str = "running",
) -> DataFrame:
    """Inclusive running sum of ``amount`` (1 when absent) in each group.

    ``order`` must tell rows of a group apart for the result to be unique.
    """
    amount = F.lit(1).cast("long") if amount is None else amount
    slices = _sorted_slices(df.withColumn("_scan_amount", amount), keys, order)
    totals = slices.groupBy(*keys, SLICE).agg(F.sum("_scan_amount").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, SLICE, F.sum("_total").over(earlier).alias("_scan_carried"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    scanned = slices.withColumn("_scan_here", F.sum("_scan_amount").over(inside))
    joined = _join_slices(scanned, carried, keys)
    total = F.col("_scan_here") + F.coalesce(F.col("_scan_carried"), F.lit(0))
    return joined.withColumn(out, total).drop("_scan_amount", "_scan_here", "_scan_carried", SLICE, PLACE)


def row_positions(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), out: str = "position"
) -> DataFrame:
    """1, 2, 3, ... by ``order``, over the table or inside each group."""
    return running_total(df, keys, order, out=out)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", descending=True) -> DataFrame:
    """Rank of ``value`` in its group, ties sharing their mean rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranked = running_total(counts, keys, [order], F.col("_ties"), "_upto")
    ranked = ranked.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(value).alias("_k_value"),
        (F.col("_upto") - (F.col("_ties") - 1) / F.lit(2.0)).alias(out),
    )
    match = df[value] == ranked["_k_value"]
    for k in keys:
        match = match & df[k].eqNullSafe(ranked[f"_k_{k}"])
    return df.join(ranked, match, "left").drop(*[f"_k_{k}" for k in keys], "_k_value")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles by linear interpolation, one column per entry of ``points``.

    Works on counts per distinct value, so no task holds a group's values.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    )
    upto = running_total(counts, keys, [F.col(value).asc()], F.col("_n"), "_upto")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    if keys:
        sizes = sizes.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        match = F.lit(True)
        for k in keys:
            match = match & upto[k].eqNullSafe(sizes[f"_k_{k}"])
        placed = upto.join(sizes, match)
    else:
        placed = upto.crossJoin(sizes)  # one row on the right
    last = F.col("_upto") - 1  # zero-based place of the value's last copy
    first = F.col("_upto") - F.col("_n")
    aggregates = []
    for name, p in points.items():
        at = F.lit(float(p)) * (F.col("_size") - 1)
        low, high = F.floor(at), F.ceil(at)
        v = F.col(value).cast("double")
        at_low = F.max(F.when((first <= low) & (low <= last), v))
        at_high = F.max(F.when((first <= high) & (high <= last), v))
        weight = F.max(at - low)
        aggregates.append((at_low + (at_high - at_low) * weight).alias(name))
    return placed.groupBy(*keys).agg(*aggregates)


def fill_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Nulls take the nearest earlier value of their group, else the nearest later one."""
    slices = _sorted_slices(df, keys, order)
    ends = []
    for c in columns:
        known = F.col(c).isNotNull()
        ends.append(F.max_by(F.when(known, F.col(c)), F.when(known, F.col(PLACE))).alias(f"_last_{c}"))
        ends.append(F.min_by(F.when(known, F.col(c)), F.when(known, F.col(PLACE))).alias(f"_first_{c}"))
    summary = slices.groupBy(*keys, SLICE).agg(*ends)
    across = Window.partitionBy(*keys).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    carried = summary.select(
        *keys,
        SLICE,
        *[F.last(f"_last_{c}", True).over(before).alias(f"_down_{c}") for c in columns],
        *[F.first(f"_first_{c}", True).over(after).alias(f"_up_{c}") for c in columns],
    )
    joined = _join_slices(slices, carried, keys)
    inside = Window.partitionBy(*keys, SLICE).orderBy(PLACE)
    down = inside.rowsBetween(Window.unboundedPreceding, 0)
    up = inside.rowsBetween(0, Window.unboundedFollowing)
    filled = {
        c: F.coalesce(
            F.last(c, True).over(down), F.col(f"_down_{c}"), F.first(c, True).over(up), F.col(f"_up_{c}")
        )
        for c in columns
    }
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
