"""Feature preparation: levels, splits, imputing, dummies, resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators import schema
from harrow.operators.aggregates import modes
from harrow.operators.groups import shuffle_key
from harrow.operators.order import row_positions

MISSING_LEVEL, OTHER_LEVEL, MISSING_VALUE = "missing", "OTHER", "missing_value"


def collapse_rare(df: DataFrame, column: str, group: str, share: float = 0.01) -> DataFrame:
    """Null becomes ``missing``; levels with fewer rows than a share of the
    distinct groups (rounded down) become ``OTHER``."""
    known = df.withColumn(column, F.coalesce(F.col(column), F.lit(MISSING_LEVEL)))
    cut = known.agg(F.floor(F.count_distinct(group) * F.lit(share)).alias("_cut"))
    levels = known.groupBy(F.col(column).alias("_level")).agg(F.count("*").alias("_n"))
    kept = levels.crossJoin(cut).where("_n >= _cut").select("_level")  # one row on the right
    joined = known.join(kept, known[column] == kept["_level"], "left")
    return joined.withColumn(
        column, F.when(F.col("_level").isNotNull(), F.col(column)).otherwise(F.lit(OTHER_LEVEL))
    ).drop("_level")


def split_by_group(df: DataFrame, group: str, share: float = 0.8, seed: int = 42, out: str = "is_train") -> DataFrame:
    """Train flag such that a group is on one side: the first share of the
    groups in a repeatable random order."""
    names = df.select(F.col(group).alias("_g")).distinct()
    ranked = row_positions(names, [shuffle_key(seed, "_g"), F.col("_g")], out="_rank")
    size = names.agg(F.floor(F.count("*") * F.lit(share)).alias("_cut"))
    side = ranked.crossJoin(size).select("_g", (F.col("_rank") <= F.col("_cut")).alias(out))  # one row
    return df.join(side, df[group].eqNullSafe(side["_g"])).drop("_g")


def split_rows(df: DataFrame, key: str, share: float = 0.8, seed: int = 42, out: str = "is_train") -> DataFrame:
    """Random row split by a hash of the key; the same row always falls on the same side."""
    return df.withColumn(out, draw_number(seed, F.col(key)) % 1_000_000 < int(share * 1_000_000))


def impute_mean(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Train means fill nulls in the train table and in the others."""
    means = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    filled = []
    for t in [train, *others]:
        joined = t.crossJoin(means)  # one row
        filled.append(
            joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(
                *[f"_m_{c}" for c in columns]
            )
        )
    return filled


def impute_constant(df: DataFrame, columns: Sequence[str], value: str = MISSING_VALUE) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value, the smallest on ties."""
    best = [modes(df, [], c, f"_m_{c}") for c in columns]
    joined = reduce(lambda d, m: d.crossJoin(m), best, df)  # one row each
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(
        *[f"_m_{c}" for c in columns]
    )


def levels_of(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """Sorted levels of a column that has at most ``most``; collapse rare ones first."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} levels; collapse the rare ones first")
    return [r[0] for r in rows]


def dummies(df: DataFrame, levels: Mapping[str, Sequence[str]], prefix: bool = True) -> DataFrame:
    """0/1 columns ``<column>_<level>``, the source columns dropped."""
    new = {
        (f"{c}_{v}" if prefix else str(v)): F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
        for c, values in levels.items()
        for v in values
    }
    return df.withColumns(new).drop(*levels)


def one_hot(train: DataFrame, columns: Sequence[str]):
    """Encoder fitted on train; unknown test levels give a zero row."""
    indexed = [f"{c}_index" for c in columns]
    stages = [
        StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_hot" for c in columns], dropLast=True),
    ]
    return Pipeline(stages=stages).fit(train)


def align(train: DataFrame, test: DataFrame, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to their common columns less ids and outcomes, same order."""
    names = [c for c in schema.common_columns([train, test]) if c not in set(drop)]
    return train.select(*names), test.select(*names)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def draw_number(seed: int, draw: Column) -> Column:
    """A repeatable 32-bit number for a draw."""
    digest = F.md5(F.concat_ws(":", draw.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def upsample(df: DataFrame, label: str, minority, key: str, seed: int = 91988) -> DataFrame:
    """Majority rows plus minority rows drawn with replacement to the same size.

    Draws are numbered 1..n and each picks a minority row by its place, so the
    size is exact and a rerun gives the same rows. ``draw`` is 0 for majority rows.
    """
    small = row_positions(df.where(F.col(label) == F.lit(minority)), [F.col(key).asc()], out="_place")
    large = df.where(F.col(label) != F.lit(minority))
    sizes = df.agg(
        F.count_if(F.col(label) == F.lit(minority)).alias("_small"), F.count_if(F.col(label) != F.lit(minority)).alias("_large")
    ).first()
    if not sizes["_small"]:
        raise ValueError("no row of the minority class")
    draws = df.sparkSession.range(1, sizes["_large"] + 1).select(
        F.col("id").alias("draw"), (draw_number(seed, F.col("id")) % sizes["_small"] + 1).alias("_place")
    )
    drawn = draws.join(small, "_place").drop("_place")
    return large.withColumn("draw", F.lit(0).cast("long")).unionByName(drawn)


def binary_label(df: DataFrame, positive: str, dropped: str, out: str = "label") -> DataFrame:
    """1 / 0 from a dummy column after the rows of another class are removed."""
    return df.where(F.col(dropped) != 1).withColumn(out, (F.col(positive) == 1).cast("int"))


def drop_unusable(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Drop id columns and columns without any value (one pass)."""
    rest = [c for c in df.columns if c not in set(ids)]
    filled = df.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in rest]).first()
    return df.select(*[c for c in rest if filled[c]])
