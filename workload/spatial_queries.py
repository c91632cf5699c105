"""Points and polygons taken from the embeddings and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions.geometry import point
from harrow.operators import spatial
from workload.registry import query


def diamonds(t):
    """A diamond around the centre of each label's first two coordinates."""
    e = t.embeddings.select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    c = e.groupBy(F.col("label").alias("area")).agg(
        F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"), F.round(F.stddev_samp("x"), 4).alias("r")
    )
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    ring = F.array(point(cx - r, cy), point(cx, cy + r), point(cx + r, cy), point(cx, cy - r))
    return c.select("area", F.array(ring).alias("rings"))


def vector_points(t):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    known = F.abs(x) > 0.01
    return t.embeddings.select("vec_id", F.when(known, x).alias("x"), F.when(known, y).alias("y"))


@query(
    "JN-16 GEO-01 SRC-07 PL-06",
    """
    WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    c AS (SELECT label AS area, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(stddev_samp(x), 4) AS r FROM e GROUP BY 1)
    SELECT vec_id, area FROM e LEFT JOIN c ON abs(x) > 0.01 AND abs(x - cx) + abs(y - cy) <= r
    """,
)
def points_in_polygons(t):
    return spatial.join_points(vector_points(t), diamonds(t), "x", "y", "rings").select("vec_id", "area")


@query(
    "GEO-02",
    """
    SELECT c_custkey, round((c_nationkey + 1 + c_acctbal / 1000 + 3) / 3, 6) AS lon, round((1 + 2 + c_acctbal / 500 + 30) / 3, 6) AS lat
    FROM customer
    """,
)
def polygon_centroids(t):
    corners = F.array(
        point(F.col("c_nationkey") + 1, F.lit(1)),
        point(F.col("c_acctbal") / 1000, F.lit(2) + F.col("c_acctbal") / 500),
        point(F.lit(3), F.lit(30)),
    )
    shapes = t.customer.select("c_custkey", F.array(corners).alias("rings"))
    out = spatial.with_centroid(shapes, "rings")
    return out.select("c_custkey", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
