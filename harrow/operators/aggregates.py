"""Counting, summarising and reshaping.

Aggregates combine before the shuffle; distinct counts are first reduced to
distinct pairs, so a hot group costs one row per task and value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.operators.order import quantiles, running_total


def frequency(df: DataFrame, columns: Sequence[str], nulls: bool = True, count: str = "n", share: str = "") -> DataFrame:
    """Rows per combination of values; ``share`` adds the part of all counted rows."""
    source = df if nulls else df.dropna(subset=list(columns))
    counts = source.groupBy(*columns).agg(F.count("*").alias(count))
    if not share:
        return counts
    total = source.agg(F.count("*").alias("_all"))
    return counts.crossJoin(total).withColumn(share, F.col(count) / F.col("_all")).drop("_all")  # one row


def ratio_per_unit(df: DataFrame, keys: Sequence[str], measure: str, unit: str) -> DataFrame:
    """Mean, sum and non-null count of a measure, sum of a unit, and sum per unit.

    Rows with a null key drop.
    """
    grouped = df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.avg(measure).alias("mean_measure"),
        F.sum(measure).alias("sum_measure"),
        F.count(measure).alias("count_measure"),
        F.sum(unit).alias("sum_unit"),
    )
    return grouped.withColumn("per_unit", F.try_divide(F.col("sum_measure"), F.col("sum_unit")))


def sums_and_means(df: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(f"sum_{c}") for c in sums], *[F.avg(c).alias(f"mean_{c}") for c in means]
    )


def distinct_counts(df: DataFrame, keys: Sequence[str], unit: str, conditions: Mapping[str, Column | None]) -> DataFrame:
    """Distinct units per group, plain (``None``) or under a condition.

    Rows are reduced to one per group and unit, which knows the conditions it met.
    """
    met = {n: F.lit(True) if c is None else F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    units = df.groupBy(*keys, F.col(unit).alias("_unit")).agg(*[F.bool_or(c).alias(n) for n, c in met.items()])
    return units.groupBy(*keys).agg(*[F.count_if(F.col("_unit").isNotNull() & F.col(n)).alias(n) for n in met])


def distinct_proportions(
    df: DataFrame, keys: Sequence[str], unit: str, category: str, values: Mapping[str, str]
) -> DataFrame:
    """Share of a group's distinct units in each category; ``values`` maps column to category."""
    names = {n: F.col(category) == v for n, v in values.items()}
    counted = distinct_counts(df, keys, unit, {"unique_units": None, **names})
    return counted.withColumns({n: F.try_divide(F.col(n), F.col("unique_units")) for n in names})


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5})


def share_true(c: Column) -> Column:
    return F.avg(c.cast("double"))


def modes(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per group; of equally frequent ones the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.v").alias(out))


def all_modes(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """Every most frequent non-null value per group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("_n").alias("_best"))
    match = counts["_n"] == best["_best"]
    for k in keys:
        match = match & counts[k].eqNullSafe(best[f"_k_{k}"])
    return counts.join(best, match).select(*keys, F.col(value).alias(out))


def representative_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per key, each column reduced by its type.

    Numbers: mean. Text: mode, smallest on ties. Dates: earliest, but latest
    when the name says END.
    """
    plain, texts = [], []
    for field in df.schema.fields:
        if field.name == key:
            continue
        if isinstance(field.dataType, T.NumericType):
            plain.append(F.avg(field.name).alias(field.name))
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            pick = F.max if "END" in field.name.upper() else F.min
            plain.append(pick(field.name).alias(field.name))
        else:
            texts.append(field.name)
    base = df.groupBy(key).agg(*plain) if plain else df.select(key).distinct()
    if texts:
        # one long pass for all text columns instead of one job per column
        long = df.select(key, *texts).unpivot([key], texts, "_column", "_value")
        best = modes(long, [key, "_column"], "_value", "_mode")
        wide = best.groupBy(key).pivot("_column", texts).agg(F.first("_mode"))
        wide = wide.withColumnRenamed(key, "_key")
        base = base.join(wide, base[key].eqNullSafe(wide["_key"]), "left").drop("_key")
    return base.select(*df.columns)


def concat_text(
    df: DataFrame, key: str, text: str, order: Sequence[str], sep: str = " || ", part_chars: int = 100_000_000
) -> DataFrame:
    """A group's texts in order, joined by ``sep``, line breaks removed.

    Columns: key, part, text, n_chars. A group is a row for each begun
    ``part_chars`` characters, numbered from 0; parts after the first begin with the
    separator, so a group's text is its parts put together in order. A task holds one
    part, and nothing is cut.
    """
    known = df.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    piece = F.regexp_replace(F.col(text), "\n", "")
    known = known.select(key, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], piece.alias("_text"))
    sizes = known.groupBy(F.col(key).alias("_key")).agg(F.sum(F.length("_text") + len(sep)).alias("_size"))
    joined = known.join(sizes, known[key] == sizes["_key"]).drop("_key")
    by = [f"_o{i}" for i in range(len(order))]
    small = joined.where(F.col("_size") <= part_chars).withColumn("part", F.lit(0).cast("long"))
    big = joined.where(F.col("_size") > part_chars)
    columns = [key, *by, "_text", "part"]
    # position by the characters before each piece
    upto = running_total(big, [key], [F.col(c) for c in by], F.length("_text") + len(sep), "_upto")
    start = F.col("_upto") - F.length("_text") - len(sep)
    placed = small.select(*columns).unionByName(upto.withColumn("part", F.floor(start / part_chars)).select(*columns))
    gathered = F.array_sort(F.collect_list(F.struct(*by, "_text")))
    out = placed.groupBy(key, "part").agg(F.array_join(gathered["_text"], sep).alias("_joined"))
    out = out.select(key, "part", F.concat(F.when(F.col("part") > 0, sep).otherwise(""), "_joined").alias("text"))
    return out.withColumn("n_chars", F.length("text"))


def flag_at_quantile(df: DataFrame, value: str, q: float, out: str = "is_high") -> DataFrame:
    """Whether a row reaches the table's ``q`` quantile."""
    cut = quantiles(df, [], value, {"_cut": q})
    return df.crossJoin(cut).withColumn(out, F.col(value) >= F.col("_cut")).drop("_cut")  # one row


def describe(df: DataFrame, numbers: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """Long summary (variable, statistic, value): exact quartiles, sample deviation."""
    long_parts = []
    if numbers:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(
            [], list(numbers), "variable", "x"
        )
        moments = long.groupBy("variable").agg(
            F.count("x").cast("double").alias("count"),
            F.avg("x").alias("mean"),
            F.stddev_samp("x").alias("std"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
        )
        quarters = quantiles(long, ["variable"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
        wide = moments.join(quarters, "variable", "left")
        stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
        long_parts.append(wide.unpivot(["variable"], stats, "statistic", "value"))
    if texts:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in texts]).unpivot([], list(texts), "variable", "x")
        wide = long.groupBy("variable").agg(
            F.count("x").cast("double").alias("count"), F.count_distinct("x").cast("double").alias("unique")
        )
        long_parts.append(wide.unpivot(["variable"], ["count", "unique"], "statistic", "value"))
    return reduce(DataFrame.unionByName, long_parts)


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, most first."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "variable", "nulls").orderBy(F.desc("nulls"), "variable")


def date_range(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def subset_shares(df: DataFrame, condition: Column, unit: str) -> DataFrame:
    """Rows and distinct units, those under a condition, and both shares."""
    units = df.groupBy(F.col(unit).alias("_unit")).agg(F.count("*").alias("_rows"), F.count_if(condition).alias("_with"))
    known = F.col("_unit").isNotNull()
    counted = units.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("_with"), F.lit(0)).alias("n_rows_with"),
        F.count_if(known).alias("n_units"),
        F.count_if(known & (F.col("_with") > 0)).alias("n_units_with"),
    )
    return counted.withColumns({
        "share_rows_with": F.try_divide(F.col("n_rows_with"), F.col("n_rows")),
        "share_units_with": F.try_divide(F.col("n_units_with"), F.col("n_units")),
    })


def widen(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide, mean of duplicates; ``names`` saves the job that would list them."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.avg(value))


def lengthen(df: DataFrame, keys: Sequence[str], values: Sequence[str], name="variable", value="value") -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def cross_counts(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts over the whole two-by-two grid of boolean outcomes, in long form."""
    cells = {
        (a, p): F.count_if((F.col(actual) == F.lit(a)) & (F.col(predicted) == F.lit(p)))
        for a in (False, True)
        for p in (False, True)
    }
    grouped = df.groupBy(*keys).agg(*[c.alias(f"_{a}_{p}") for (a, p), c in cells.items()])
    rows = F.array(
        *[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_{a}_{p}").alias("n")) for a, p in cells]
    )
    return grouped.select(*keys, F.inline(rows))


def percent_positive(df: DataFrame, category: str, flag: Column) -> DataFrame:
    """Percent positive per category; categories without both classes drop."""
    counted = df.where(F.col(category).isNotNull()).groupBy(category).agg(
        F.count_if(flag).alias("positives"), F.count_if(~flag).alias("negatives")
    )
    both = counted.where((F.col("positives") > 0) & (F.col("negatives") > 0))
    total = F.col("positives") + F.col("negatives")
    return both.withColumn("percent_positive", F.col("positives") / total * 100)


def ratio_to_first(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "ratio") -> DataFrame:
    """Each later row of a group over the group's first row; zero base gives null."""
    first = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.min(order).alias("_first"), F.min_by(value, order).alias("_base")
    )
    match = F.lit(True)
    for k in keys:
        match = match & df[k].eqNullSafe(first[f"_k_{k}"])
    joined = df.join(first, match).where(F.col(order) > F.col("_first"))
    result = joined.withColumn(out, F.try_divide(F.col(value), F.col("_base")))
    return result.drop(*[f"_k_{k}" for k in keys], "_first", "_base")


def all_missing_flags(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per row: does its group lack a value in every row?"""
    flags = df.groupBy(F.col(key).alias("_key")).agg(
        *[F.bool_and(F.col(c).isNull()).alias(f"all_{c}_missing") for c in columns]
    )
    return df.join(flags, df[key].eqNullSafe(flags["_key"])).drop("_key")


def first_of_duplicates(df: DataFrame, subset: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per subset by a stated order.

    ``row_number <= 1`` is applied inside every map task before the shuffle, so
    a hot subset arrives as one row per task.
    """
    place = F.row_number().over(Window.partitionBy(*subset).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= 1).drop("_place")


def all_duplicates(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Every row whose subset occurs more than once.

    Hashes are counted first, so only rows whose hash recurs are compared, and moved, whole.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*subset))
    again = hashed.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    df = hashed.join(again, "_hash", "left_semi").drop("_hash")
    repeated = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in subset]).agg(F.count("*").alias("_n"))
    repeated = repeated.where("_n > 1")
    match = F.lit(True)
    for c in subset:
        match = match & df[c].eqNullSafe(repeated[f"_k_{c}"])
    return df.join(repeated, match, "left_semi")


def mean_of_distinct(df: DataFrame, keys: Sequence[str], value: str, distinct_on: Sequence[str]) -> DataFrame:
    """Group mean over distinct rows, not-a-number ignored."""
    rows = df.select(*dict.fromkeys([*distinct_on, *keys, value])).distinct()
    return rows.groupBy(*keys).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(f"mean_{value}"))


def class_percents(df: DataFrame, keys: Sequence[str], total: int | Column | None = None) -> DataFrame:
    """Rows per key combination and their percent of a total (default: the largest first-key total)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    if total is None:
        sizes = counts.groupBy(keys[0]).agg(F.sum("n").alias("_t")).agg(F.max("_t").alias("_total"))
        counts = counts.crossJoin(sizes)  # one row
    else:
        counts = counts.withColumn("_total", F.lit(total))
    return counts.withColumn("percent", F.col("n") / F.col("_total") * 100).drop("_total")


def top_category_examples(df: DataFrame, category: str, order: Sequence[Column], k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows with an indicator of the ``k`` largest categories, one example row for each of those)."""
    sizes = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("_n"))
    top = sizes.orderBy(F.desc("_n"), category).limit(k).select(F.col(category).alias("_top"))
    marked = df.join(top, df[category] == top["_top"], "left")
    marked = marked.withColumn("is_top_category", F.col("_top").isNotNull()).drop("_top")
    examples = first_of_duplicates(marked.where("is_top_category"), [category], order)
    return marked, examples
