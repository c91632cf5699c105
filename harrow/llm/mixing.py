"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import WORD, leading_bits, parts_for, without
from harrow.session import cut_lineage

RESULTS = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, source: str = "source", weights: Sequence[int] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, source_size, target) from a row (source, source_size) for each source.

    Sources in code point order, null last, weigh by ``weights`` in turn and share the
    sum of sizes; a target stops at ``limit`` times its source's size and the excess is
    shared again by weight. Ordered by size per weight the stopped sources come first,
    so a running sum tells where stopping ends. The table has a row a source, whatever
    the number of documents.
    """
    ordered = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.select(source, "source_size", weight.cast("long").alias("weight"))
    by_need = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col(source).asc_nulls_last())
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    shared = weighed.withColumn("left", left).withColumn("open", F.sum("weight").over(after))
    shared = shared.withColumn("stopped", limit * F.col("source_size") * F.col("open") <= F.col("left") * F.col("weight"))
    # all before the first source that is not stopped
    shared = shared.withColumn("stopped", F.min(F.col("stopped").cast("int")).over(by_need.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rest = F.min(F.when(~F.col("stopped"), F.struct((-F.col("open")).alias("o"), F.col("left").alias("l")))).over(everything)
    target = F.when(F.col("stopped"), (limit * F.col("source_size")).cast("double")).otherwise((rest["l"] * F.col("weight")) / (-rest["o"]))
    return shared.select(source, "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    limit: int = 3,
    seed: int = 0,
    rows_per_part: int = 10_000,
    prefix: str = "",
) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, copies, taken (each with ``prefix``).

    A document's size is its number of words. Within a source, documents stand by size,
    largest first, then by a hash of the id; each expects target / source_size copies.
    One offset per source, from the seed, is added to the running sum of expected
    copies, and a document is taken once for each integer crossed. Neighbours are of
    like size, so the words taken miss the target by at most the largest document.

    Null texts have size 0; a null source is a source of its own, the last; null ids and
    repeated rows are rows like others (ties go by id). A source without words takes
    nothing. An empty table gives no rows. Columns of the results' names are replaced.

    Positions come from counts per (source, size) and per hash part of those, so no
    task holds a source; a source has at most sqrt(2 * its words) different sizes.
    """
    names = [prefix + n for n in RESULTS]
    kept = without(docs, names)
    text = F.coalesce(F.col(text_column), F.lit(""))
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"))
    rows = kept.select("*", F.regexp_count(text, F.lit(WORD)).cast("long").alias(names[0]), tie.alias("__mix_tie"))
    size = F.col(names[0])
    # counts at the finest grain, which serve all further sums
    fine = rows.select(F.col(source_column).alias("s"), size.alias("z"), leading_bits(F.col("__mix_tie"), 1 << 12).alias("h"))
    fine = cut_lineage(fine.groupBy("s", "z", "h").agg(F.count("*").alias("n")))
    total = fine.agg(F.sum("n")).first()[0] or 0
    parts = min(1 << 12, parts_for(total, rows_per_part))
    counts = fine.groupBy("s", "z", F.floor(F.col("h") * parts / (1 << 12)).cast("int").alias("p")).agg(F.sum("n").alias("n"))
    by_size = fine.groupBy("s", "z").agg(F.sum("n").alias("n"))
    targets = source_targets(by_size.groupBy("s").agg(F.sum(F.col("n") * F.col("z")).alias("source_size")), "s", weights, limit)
    larger = Window.partitionBy("s").orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("s", "z", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("above"))
    earlier = Window.partitionBy("s", "z").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("s", "z", "p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("inside"))
    same = by_size["s"].eqNullSafe(targets["s"])
    by_size = by_size.join(targets, same).select(by_size["s"].alias("s1"), F.col("z").alias("z1"), "above", "source_size", "target")
    bases = counts.join(by_size, F.col("s").eqNullSafe(F.col("s1")) & (F.col("z") == F.col("z1")))
    bases = bases.select(
        F.col("s").alias("__mix_s"), F.col("z").alias("__mix_z"), F.col("p").alias("__mix_p0"),
        (F.col("above") + F.col("inside")).alias("__mix_base"), F.col("source_size").alias("__mix_total"), F.col("target").alias("__mix_target"),
    )
    part = F.floor(leading_bits(F.col("__mix_tie"), 1 << 12) * parts / (1 << 12)).cast("int")
    joined = rows.withColumn("__mix_p", part).join(
        bases, F.col(source_column).eqNullSafe(F.col("__mix_s")) & (size == F.col("__mix_z")) & (F.col("__mix_p") == F.col("__mix_p0"))
    )
    within = Window.partitionBy("__mix_s", "__mix_z", "__mix_p0").orderBy("__mix_tie", F.col(id_column))
    place = F.col("__mix_base") + F.row_number().over(within) - 1
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(source_column), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / (1 << 32)
    rate = F.when(F.col("__mix_total") > 0, F.col("__mix_target") / F.col("__mix_total")).otherwise(0.0)
    crossed = F.floor(offset + (F.col("__mix_place") + 1) * rate) - F.floor(offset + F.col("__mix_place") * rate)
    return (
        joined.withColumn("__mix_place", place)
        .withColumn(names[3], F.least(crossed, F.lit(limit)).cast("long"))
        .withColumns({names[1]: F.col("__mix_total"), names[2]: F.col("__mix_target"), names[4]: F.col(names[3]) * size})
        .select(*kept.columns, *names)
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as it was taken, in the columns of ``docs``."""
    taken = mix(docs, prefix="__mix_", **options)
    return taken.where(F.col("__mix_copies") > 0).withColumn(
        "__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))
    ).select(*docs.columns)
