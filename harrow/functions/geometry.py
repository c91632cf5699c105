"""Points, rings and polygons as plain columns.

A polygon is an array of rings, a ring an array of ``struct<x, y>``. Rings may
or may not repeat their first point at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def edges(rings: Column) -> Column:
    """All edges of all rings as ``struct<ax, ay, bx, by>``."""

    def ring_edges(ring):
        def edge(p, i):
            nxt = F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(F.lit(0)))
            return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), nxt["x"].alias("bx"), nxt["y"].alias("by"))

        return F.transform(ring, edge)

    return F.flatten(F.transform(rings, ring_edges))


def contains(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd test over all edges; points on an edge are inside."""

    def cross(e):
        return (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])

    def touches(e):
        return (
            (cross(e) == 0)
            & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
            & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        )

    def crosses(e):
        spans = (e["ay"] > y) != (e["by"] > y)
        # the level edge never spans, so the divisor is never zero where it counts
        at = e["ax"] + F.try_divide((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"])
        return spans & (x < at)

    odd = F.size(F.filter(edge_list, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return F.exists(edge_list, touches) | odd


def bounds(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)}


def centroid(rings: Column) -> tuple[Column, Column]:
    """(x, y) of the area's centre; holes run against their outer ring."""

    def total(term):
        return F.aggregate(edges(rings), F.lit(0.0), lambda acc, e: acc + term(e))

    def cross(e):
        return e["ax"] * e["by"] - e["bx"] * e["ay"]

    area2 = total(cross)
    x = total(lambda e: (e["ax"] + e["bx"]) * cross(e))
    y = total(lambda e: (e["ay"] + e["by"]) * cross(e))
    return F.try_divide(x, area2 * 3), F.try_divide(y, area2 * 3)
