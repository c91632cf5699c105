"""Ids, representatives, ranks, top cuts, samples and key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.aggregates import first_of_duplicates
from harrow.operators.order import row_positions, running_total


def earliest_of_group(df: DataFrame, group: str, date: str, tie: str) -> DataFrame:
    """One row per group: earliest date, null dates last, ties by id."""
    return first_of_duplicates(df, [group], [F.col(date).asc_nulls_last(), F.col(tie).asc()])


def split_groups_by(df: DataFrame, group: str, part: str, out: str) -> DataFrame:
    """Composite id ``group_code`` so that each new group holds one value of ``part``.

    Codes follow the sorted values inside the group, null last. They are worked
    out on distinct pairs, then joined back.
    """
    pairs = df.select(F.col(group).alias("_g"), F.col(part).alias("_p")).distinct()
    coded = row_positions(pairs, [F.col("_p").asc_nulls_last()], ["_g"], "_code")
    joined = df.join(coded, df[group].eqNullSafe(coded["_g"]) & df[part].eqNullSafe(coded["_p"]))
    return joined.withColumn(out, F.concat_ws("_", F.col(group), F.col("_code"))).drop("_g", "_p", "_code")


def top_fraction(
    df: DataFrame, model: str, score: str, tie: str, fraction: float = 0.05, out: str = "is_top"
) -> DataFrame:
    """Flag the rows of each model within the top fraction by score, ties by id.

    The cut is round-half-even of fraction times the model's row count.
    """
    ranked = row_positions(df, [F.col(score).desc(), F.col(tie).asc()], [model], "rank_score")
    sizes = df.groupBy(F.col(model).alias("_m")).agg(F.bround(F.count("*") * F.lit(fraction)).alias("_cut"))
    joined = ranked.join(sizes, ranked[model].eqNullSafe(sizes["_m"]))
    return joined.withColumn(out, F.col("rank_score") <= F.col("_cut")).drop("_m", "_cut")


def single_value_groups(df: DataFrame, group: str, value: str, out: str = "is_single") -> DataFrame:
    """Whether a row's group holds exactly one distinct value, null being a value."""
    shown = F.struct(F.col(value).alias("v"))
    flags = df.groupBy(F.col(group).alias("_g")).agg((F.count_distinct(shown) == 1).alias(out))
    return df.join(flags, df[group].eqNullSafe(flags["_g"])).drop("_g")


def compare_ranks(df: DataFrame, model: str, name: str, value: str, models: Sequence[str]) -> DataFrame:
    """Descending rank of each name inside its model, models side by side."""
    ranked = row_positions(
        df.where(F.col(model).isin(list(models))), [F.col(value).desc(), F.col(name).asc()], [model], "_rank"
    )
    return ranked.groupBy(name).pivot(model, list(models)).agg(F.max("_rank"))


def top_rows(df: DataFrame, order: Sequence[Column], k: int, condition: Column | None = None) -> DataFrame:
    kept = df if condition is None else df.where(condition)
    return kept.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "place") -> DataFrame:
    """First ``k`` rows of each group; the cut runs in the map tasks too."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(out, place).where(F.col(out) <= k)


def longest_texts(df: DataFrame, text: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.length(text).desc_nulls_last(), F.col(tie)).limit(k)


def shuffle_key(seed: int, *ids: str) -> Column:
    """A repeatable pseudo-random order of ids."""
    return F.md5(F.concat_ws(":", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))).cast("binary"))


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    return df.orderBy(shuffle_key(seed, key), key).limit(n)


def keys_only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, out: str = "key") -> DataFrame:
    """Distinct keys of both tables, compared in upper case."""
    a = left.select(F.upper(F.col(left_key)).alias(out))
    return a.intersect(right.select(F.upper(F.col(right_key)).alias(out)))


def key_category(
    universe: DataFrame, first: DataFrame, second: DataFrame, key: str, names: tuple[str, str], out: str = "category"
) -> DataFrame:
    """Per key of the universe: only first, only second, both, or neither."""
    tagged = (
        universe.select(key, F.lit(0).alias("_a"), F.lit(0).alias("_b"), F.lit(1).alias("_u"))
        .unionByName(first.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b"), F.lit(0).alias("_u")))
        .unionByName(second.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"), F.lit(0).alias("_u")))
    )
    flags = tagged.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.max("_u").alias("_u"))
    label = (
        F.when((F.col("_a") == 1) & (F.col("_b") == 1), F.lit("Both"))
        .when(F.col("_a") == 1, F.lit(f"{names[0]} only"))
        .when(F.col("_b") == 1, F.lit(f"{names[1]} only"))
        .otherwise(F.lit("Neither"))
    )
    return flags.where("_u = 1").select(key, label.alias(out))


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: str, out: str) -> DataFrame:
    return running_total(df, keys, order, F.col(amount), out)
