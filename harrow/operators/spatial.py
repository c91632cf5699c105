"""Point in polygon by grid cells of several sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import geometry
from harrow.session import cut_lineage

#: Edges of a strip about; edges of a layer, of 32 bytes each, that are broadcast at most.
EDGES_IN_STRIP, BROADCAST_EDGES = 64, 200_000


def join_points(
    points: DataFrame, polygons: DataFrame, x: str, y: str, rings: str, cell: float | None = None, edges_in_strip: int = EDGES_IN_STRIP
) -> DataFrame:
    """Points with the polygons they lie in or on, all points kept.

    A point in no polygon, or without coordinates, has null polygon columns; a point in
    several occurs once for each.

    Polygons are filed in a grid whose cells are as large as they are: level 0 has cells
    of side ``cell``, each further one of four times that, and a polygon goes to the
    first level whose cells are not smaller than its box. So it meets four cells at most,
    whatever the sizes of the others, and a point is looked up once on each level in use.
    A polygon of many edges is cut into level strips with those edges that reach into
    each, about ``edges_in_strip``; these alone decide about a point in the strip, and the
    test on them is that on all edges.

    ``cell`` is the smallest polygon's side, or a millionth of the largest's if that is
    more, unless given. Polygons of up to ``BROADCAST_EDGES`` edges in all are broadcast;
    larger layers are joined by a shuffle, in which the adaptive planner splits a cell
    with many points.
    """
    attributes = [c for c in polygons.columns if c != rings]
    placed = polygons.select(
        *attributes, geometry.edges(F.col(rings)).alias("_edges"), *[c.alias(f"_{n}") for n, c in geometry.bounds(F.col(rings)).items()]
    )
    placed = cut_lineage(placed.where(F.size("_edges") > 0).withColumn("_polygon", F.monotonically_increasing_id()))
    side = F.greatest(F.col("_max_x") - F.col("_min_x"), F.col("_max_y") - F.col("_min_y"))
    seen = placed.agg(F.min(F.when(side > 0, side)).alias("least"), F.max(side).alias("most"), F.sum(F.size("_edges")).alias("edges")).first()
    base = cell or max(seen["least"] or 1.0, (seen["most"] or 0.0) / 4**10)
    filed = _filed(placed, attributes, side, base, edges_in_strip)
    levels = sorted(r[0] for r in placed.select(_level(side, base)).distinct().collect())  # ten or so
    near = F.broadcast if (seen["edges"] or 0) <= BROADCAST_EDGES else (lambda df: df)

    here = points.select(*points.columns, points[x].alias("_x"), points[y].alias("_y"))
    px, py = F.col("_x"), F.col("_y")
    strip = _strip(py, F.col("_min_y"), F.col("_max_y"), F.col("_strips"))
    match = (
        (F.col("_own_level") == F.col("_level")) & (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy"))
        & px.between(F.col("_min_x"), F.col("_max_x")) & py.between(F.col("_min_y"), F.col("_max_y"))
        & (strip == F.col("_strip")) & geometry.contains(F.col("_edges"), px, py)
    )

    def looked_up(df: DataFrame, level: Column) -> DataFrame:
        cells = df.withColumn("_own_level", level)
        size = _side(F.col("_own_level"), base)
        return cells.withColumns({"_px": F.floor(px / size), "_py": F.floor(py / size)})

    known = px.isNotNull() & py.isNotNull()  # null keys would pile up
    if len(levels) <= 1:
        found = looked_up(here.where(known), F.lit(levels[0] if levels else 0)).join(near(filed), match, "left")
        return found.select(*points.columns, *attributes).unionByName(here.where(~known).drop("_x", "_y"), allowMissingColumns=True)
    here = cut_lineage(here.withColumn("_point", F.monotonically_increasing_id()))
    tried = looked_up(here.where(known).select("_point", "_x", "_y", F.explode(F.array(*[F.lit(i) for i in levels])).alias("_each")), F.col("_each"))
    found = tried.join(near(filed), match).select(F.col("_point").alias("_at"), *[F.col(c).alias(f"_of_{i}") for i, c in enumerate(attributes)])
    back = here.join(found, F.col("_point") == F.col("_at"), "left")
    return back.select(*points.columns, *[F.col(f"_of_{i}").alias(c) for i, c in enumerate(attributes)])


def _side(level: Column, base: float) -> Column:
    return F.lit(base) * F.pow(F.lit(4.0), level)


def _level(side: Column, base: float) -> Column:
    """The first level whose cells are not smaller than the side."""
    about = F.greatest(F.lit(0), F.ceil(F.log(4.0, side / base) - 0.01).cast("int"))
    about = F.when(side > base, about).otherwise(0)
    return F.when(_side(about, base) < side, about + 1).otherwise(about)


def _strip(y: Column, low: Column, high: Column, strips: Column) -> Column:
    """The number of the strip that a height falls in; it never falls as the height rises."""
    share = F.coalesce(F.try_divide(y - low, high - low), F.lit(0.0))
    return F.greatest(F.lit(0), F.least(strips - 1, F.floor(share * strips).cast("int")))


def _filed(placed: DataFrame, attributes: list[str], side: Column, base: float, edges_in_strip: int) -> DataFrame:
    """The polygons' strips with their edges, once for each cell that the polygon's box meets."""
    sized = placed.withColumn("_strips", F.ceil(F.size("_edges") / F.lit(edges_in_strip)).cast("int"))
    whole = sized.where(F.col("_strips") == 1).withColumn("_strip", F.lit(0))
    many = sized.where(F.col("_strips") > 1)
    edges = many.select("_polygon", "_min_y", "_max_y", "_strips", F.explode("_edges").alias("e"))
    ends = [_strip(f("e.ay", "e.by"), F.col("_min_y"), F.col("_max_y"), F.col("_strips")) for f in (F.least, F.greatest)]
    strips = edges.select(F.col("_polygon").alias("_of"), "e", F.explode(F.sequence(*ends)).alias("_strip"))
    strips = strips.groupBy("_of", "_strip").agg(F.collect_list("e").alias("_in_strip"))
    cut = many.drop("_edges").join(strips, F.col("_polygon") == F.col("_of")).drop("_of").withColumnRenamed("_in_strip", "_edges")
    rows = whole.unionByName(cut).withColumn("_level", _level(side, base))
    size = _side(F.col("_level"), base)
    bounds = ["_edges", "_min_x", "_max_x", "_min_y", "_max_y", "_strips", "_strip", "_level"]

    def cells(axis: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(f"_min_{axis}") / size), F.floor(F.col(f"_max_{axis}") / size)))

    return rows.select(*attributes, *bounds, cells("x").alias("_cx")).select("*", cells("y").alias("_cy"))


def stack_layers(layers: dict[str, DataFrame], label: str = "layer") -> DataFrame:
    """Polygon layers stacked, each row naming its layer."""
    from harrow.operators.schema import stack_with_source

    return stack_with_source(layers, label)


def with_centroid(polygons: DataFrame, rings: str, x: str = "lon", y: str = "lat") -> DataFrame:
    cx, cy = geometry.centroid(F.col(rings))
    return polygons.withColumns({x: cx, y: cy})
