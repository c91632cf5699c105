"""Addresses to points to areas to area predictors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from harrow.operators import joins, spatial


def locate(
    df: DataFrame, address: str, cache: DataFrame, geocode: Callable[[DataFrame], DataFrame], polygons: DataFrame,
    x: str, y: str, rings: str, cell: float | None = None,
) -> DataFrame:
    """Each distinct address is enriched once and placed in its area once;
    rows without a point or an area stay."""
    keys = df.select(address).distinct()
    located = joins.enrich_distinct(keys, address, cache, geocode)
    placed = spatial.join_points(located, polygons, x, y, rings, cell)
    return df.join(placed, address, "left")


def with_area_predictors(df: DataFrame, predictors: DataFrame, source: str, area: str) -> DataFrame:
    """Predictors of the row's own period and area."""
    return df.join(predictors, [source, area], "left")
