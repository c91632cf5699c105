"""Review of model scores at a top cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import flags
from harrow.operators import filters, groups


def review_top_cut(
    scored: DataFrame, key: str, fraction: float = 0.05, table: DataFrame | None = None
) -> DataFrame:
    """Outcome categories per model when the top fraction by score is predicted true.

    ``scored``: model, actual (0/1), predicted_cont_true and a key. ``table``
    holds importances; models whose every value is zero are left out.
    """
    if table is not None:
        alive = filters.without_flat_groups(table, "model", "value").select("model").distinct()
        scored = scored.join(alive, "model", "left_semi")
    ranked = groups.top_fraction(scored, "model", "predicted_cont_true", key, fraction, "_top")
    category = flags.hit_category(F.col("_top"), F.col("actual") == 1).alias("category")
    counts = ranked.groupBy("model", category).agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("model").alias("_m")).agg(F.sum("n").alias("_n"))
    joined = counts.join(totals, counts["model"] == totals["_m"])
    return joined.select(
        "model",
        "category",
        "n",
        (F.col("n") / F.col("_n") * 100).alias("percent"),
        flags.predicted_side(F.col("category")).alias("side"),
    )
