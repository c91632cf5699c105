"""Small-area predictors: percent of universe, wide, every required area present."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.flags import sentinel_to_null
from harrow.functions.strings import readable_name, split_once
from harrow.operators import aggregates, joins


def long_values(wide: DataFrame, keys: Sequence[str], codebook: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Listed variables in long form, those in the codebook only."""
    long = wide.unpivot(list(keys), list(variables), "variable", "value")
    return long.join(codebook.select(F.col("name").alias("variable")), "variable", "left_semi")


def percent_of_universe(long: DataFrame, area: str) -> DataFrame:
    """Each variable over the first variable of its table and area, as a percent."""
    table, suffix = split_once(F.col("variable"))
    parts = long.withColumns({"table": table, "suffix": suffix})
    out = aggregates.ratio_to_first(parts, [area, "table"], "suffix", "value", "percent")
    return out.withColumn("percent", F.col("percent") * 100)


def area_predictors(
    wide: DataFrame, area: str, codebook: DataFrame, percent_variables: Sequence[str], level_variables: Sequence[str],
    required: DataFrame,
) -> DataFrame:
    """One row per required area: percents and plain levels, sentinels null."""
    percents = percent_of_universe(long_values(wide, [area], codebook, percent_variables), area)
    names = {split_once_name(v)[0] for v in percent_variables}
    first = {t: min(v for v in percent_variables if split_once_name(v)[0] == t) for t in names}
    shown = [v for v in percent_variables if v not in first.values()]
    spread = aggregates.widen(percents, [area], "variable", "percent", shown)
    levels = wide.select(area, *[sentinel_to_null(F.col(v)).alias(v) for v in level_variables])
    both = joins.full_by_key(spread, levels, [area])
    wanted = joins.rows_with(both, required, [area])
    return joins.add_missing_keys(wanted, required, [area])


def split_once_name(name: str) -> tuple[str, str]:
    head, _, tail = name.partition("_")
    return head, tail


def renamed_long(wide: DataFrame, keys: Sequence[str], codebook: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Long form under readable names from the codebook (name, label, concept)."""
    long = aggregates.lengthen(wide, keys, variables)
    named = codebook.select(F.concat("name", F.lit("E")).alias("variable"), readable_name(F.col("label"), F.col("concept")).alias("renamed"))
    return long.join(named, "variable", "left").drop("variable").distinct()
