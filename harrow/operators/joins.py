"""Joins beyond the plain ones.

No side carries a broadcast hint: the adaptive planner broadcasts a side when
its measured size is under the session's threshold and splits skewed
partitions of a sort-merge join otherwise. It goes by the size of what is read,
so a join that makes far more rows than it reads is dealt out here
(``join_many``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.aggregates import distinct_counts

#: Rows that a part of a key makes in ``join_many``.
MADE_ROWS = 1 << 20


def join_many(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", made_rows: int = MADE_ROWS) -> DataFrame:
    """``left.join(right, on, how)``, left or inner, for keys with many rows on both sides.

    Rows are counted first. The left rows of a key that makes more than ``made_rows`` rows are
    dealt into as many parts, each of which meets all right rows of the key. What the
    join makes is never shuffled.
    """
    on = list(on)
    sizes = left.groupBy(*on).agg(F.count("*").cast("double").alias("_n")).join(right.groupBy(*on).agg(F.count("*").alias("_m")), on)
    parts = sizes.select(*on, F.ceil(F.col("_n") * F.col("_m") / F.lit(float(made_rows))).cast("int").alias("_parts")).where("_parts > 1")
    total = parts.agg(F.sum(F.col("_parts").cast("double"))).first()[0]
    if not total:
        return left.join(right, on, how)
    spark = left.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    slots = max(2, int(min(total, most)))
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    # rows without a key meet nothing and may stand anywhere
    many = F.when(no_key, F.lit(slots)).otherwise(F.coalesce("_parts", F.lit(1)))
    hashed = [c for c, kind in left.dtypes if "map<" not in kind]
    dealt = left.join(parts, on, "left").select(*left.columns, F.pmod(F.xxhash64(*hashed), many).cast("int").alias("_part"))
    repeated = right.join(parts, on, "left").select(
        *right.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
    )
    keys = [*on, "_part"]
    return dealt.repartition(slots, *keys).join(repeated.repartition(slots, *keys), keys, how).drop("_part")


def suffix_overlap(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Give non-key columns that both sides have a side suffix."""
    shared = (set(left.columns) & set(right.columns)) - set(on)
    return tuple(
        t.withColumnsRenamed({c: c + s for c in t.columns if c in shared})
        for t, s in zip((left, right), suffixes)
    )


def join_with_suffixes(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", suffixes=("_x", "_y")
) -> DataFrame:
    a, b = suffix_overlap(left, right, on, suffixes)
    return join_many(a, b, on, how) if how in ("left", "inner") else a.join(b, list(on), how)


def join_with_indicator(
    left: DataFrame, right: DataFrame, on: Sequence[str], out: str = "_merge"
) -> DataFrame:
    """Left join that says ``both`` or ``left_only``; right keys should be unique."""
    joined = left.join(right.withColumn("_seen", F.lit(True)), list(on), "left")
    label = F.when(F.col("_seen"), F.lit("both")).otherwise(F.lit("left_only"))
    return joined.withColumn(out, label).drop("_seen")


def rows_without(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def rows_with(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def full_by_key(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join as left join plus the right rows without a partner.

    The adaptive planner can split a hot key in both parts, which it cannot do
    in a full outer join.
    """
    both = left.join(right, list(on), "left")
    return both.unionByName(rows_without(right, left, on), allowMissingColumns=True)


def add_missing_keys(df: DataFrame, required: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every required key occurs: lost ones come back with null values."""
    lost = rows_without(required.select(*on).distinct(), df, on)
    return df.unionByName(lost, allowMissingColumns=True)


def precedence_merge(
    first: DataFrame,
    second: DataFrame,
    key: str,
    columns: Sequence[str],
    lead: str,
    names: tuple[str, str],
    source: str = "source",
) -> DataFrame:
    """Merge overlapping sources, the first one winning.

    Shared key and missing value: the second source's. Shared key and present
    value: the first's. Key only in the second: appended. ``source`` says where
    the ``lead`` column came from.
    """
    a, b = first.select(key, *columns), second.select(key, *columns)
    other = b.withColumnsRenamed({c: f"_b_{c}" for c in columns})
    origin = (
        F.when(F.col(lead).isNull() & F.col(f"_b_{lead}").isNull(), F.lit("missing in both"))
        .when(F.col(lead).isNull(), F.lit(names[1]))
        .otherwise(F.lit(names[0]))
    )
    overlap = a.join(other, key, "left").select(
        key, *[F.coalesce(F.col(c), F.col(f"_b_{c}")).alias(c) for c in columns], origin.alias(source)
    )
    only_second = rows_without(b, a, [key]).withColumn(source, F.lit(f"{names[1]}_only"))
    return overlap.unionByName(only_second)


def quarter_grid(keys: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every key with every year and quarter of a closed span of years."""
    years = F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))
    quarters = F.explode(F.sequence(F.lit(1), F.lit(4)))
    return keys.distinct().select("*", years.alias("year")).select("*", quarters.alias("quarter"))


def month_calendar(df: DataFrame, date: str, out: str = "month") -> DataFrame:
    """All months from the first to the last date, one row each."""
    span = df.agg(F.trunc(F.min(date), "month").alias("_a"), F.trunc(F.max(date), "month").alias("_b"))
    months = F.sequence(F.col("_a"), F.col("_b"), F.expr("interval 1 month"))
    return span.select(F.explode(months).alias(out))


def complete_counts(counts: DataFrame, grid: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Grid rows with the counted values, zero where nothing was counted."""
    joined = grid.join(counts, list(on), "left")
    return joined.fillna(0, subset=list(values))


def look_up(df: DataFrame, key: str, codes: DataFrame, code: str, value: str, out: str) -> DataFrame:
    """Replace a code by its dictionary value, compared in upper case; unmatched drop."""
    table = codes.select(F.upper(F.col(code)).alias("_code"), F.col(value).alias(out)).dropDuplicates(["_code"])
    return df.join(table, F.upper(F.col(key)) == table["_code"], "inner").drop("_code")


def enrich_distinct(
    df: DataFrame,
    key: str,
    cache: DataFrame,
    enrich: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Enrich each distinct key once, taking cached answers first.

    ``cache`` and the result of ``enrich`` hold the key and the same value
    columns; ``enrich`` sees only keys the cache lacks.
    """
    wanted = df.select(key).where(F.col(key).isNotNull()).distinct()
    values = [c for c in cache.columns if c != key]
    answered = cache.join(wanted, key, "left_semi")
    fresh = enrich(wanted.join(cache, key, "left_anti")).select(key, *values)
    return df.join(answered.select(key, *values).unionByName(fresh), key, "left")


def match_quality(
    df: DataFrame, name: tuple[str, str], day: tuple[str, str]
) -> DataFrame:
    """Flags of a fuzzy match: same name, same date, either."""
    same_name = F.coalesce(F.col(name[0]) == F.col(name[1]), F.lit(False))
    same_day = F.coalesce(F.col(day[0]) == F.col(day[1]), F.lit(False))
    return df.withColumns({
        "exact_name": same_name, "exact_date": same_day, "exact_either": same_name | same_day
    })


def one_to_one_check(df: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Rows and distinct ids of a link table, and whether it is one to one."""
    counted = df.agg(
        F.count("*").alias("links"),
        F.count_distinct(left_id).alias("left_ids"),
        F.count_distinct(right_id).alias("right_ids"),
    )
    same = (F.col("links") == F.col("left_ids")) & (F.col("links") == F.col("right_ids"))
    return counted.withColumn("is_one_to_one", same)


def grouped_share(
    df: DataFrame, keys: Sequence[str], unit: str, condition: Column,
    total: str = "n_units", hits: str = "n_hits", share: str = "share",
) -> DataFrame:
    """Distinct units per group, those meeting a condition, and their share, in one pass."""
    counted = distinct_counts(df, keys, unit, {total: None, hits: condition})
    return counted.withColumn(share, F.coalesce(F.try_divide(F.col(hits), F.col(total)), F.lit(0.0)))


def share_of_coarser(
    df: DataFrame, fine: Sequence[str], coarse: Sequence[str], unit: str,
    num: str = "num", denom: str = "denom", share: str = "share",
) -> DataFrame:
    """Distinct units per fine group over those of the coarser group it lies in."""
    top = df.groupBy(*fine).agg(F.count_distinct(unit).alias(num))
    base = df.groupBy(*coarse).agg(F.count_distinct(unit).alias(denom))
    base = base.withColumnsRenamed({c: f"_c_{c}" for c in coarse})
    match = F.lit(True)
    for c in coarse:
        match = match & top[c].eqNullSafe(base[f"_c_{c}"])
    joined = top.join(base, match, "left").drop(*[f"_c_{c}" for c in coarse])
    return joined.withColumn(share, F.try_divide(F.col(num), F.col(denom)))
