"""Row filters."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.strings import INSTITUTIONS, SPANISH_MARKERS, contains_word_of, status_tail


def member_flag(df: DataFrame, key: Column, members: DataFrame, member: str, out: str) -> DataFrame:
    """Adds whether ``key`` occurs in ``members``; a null key is not a member."""
    known = members.select(F.col(member).alias("_member")).where(F.col("_member").isNotNull()).distinct()
    known = known.withColumn("_hit", F.lit(True))
    joined = df.join(known, key == known["_member"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_hit"), F.lit(False))).drop("_member", "_hit")


def pattern_or_member(df: DataFrame, code: str, pattern: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose code fits a pattern or occurs in another table.

    Only rows that miss the pattern go through the join.
    """
    fits = F.coalesce(F.col(code).rlike(pattern), F.lit(False))
    known = members.select(F.col(member).alias("_member")).distinct()
    rest = df.where(~fits)
    return df.where(fits).unionByName(rest.join(known, rest[code] == known["_member"], "left_semi"))


def complete_rows(df: DataFrame, columns: Sequence[str], how: str = "any") -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows set aside): a row is set aside when any / all columns are null."""
    nulls = [F.col(c).isNull() for c in columns]
    gone = reduce((lambda a, b: a | b) if how == "any" else (lambda a, b: a & b), nulls)
    return df.where(~gone), df.where(gone)


def in_period(df: DataFrame, date: str, start=None, end=None) -> DataFrame:
    """Rows with a date in the closed period; null dates drop."""
    kept = df.where(F.col(date).isNotNull())
    if start is not None:
        kept = kept.where(F.col(date) >= start)
    return kept if end is None else kept.where(F.col(date) <= end)


def without_institutions(df: DataFrame, name: str, words: Sequence[str] = INSTITUTIONS) -> DataFrame:
    """Rows whose name holds none of the words; a null name stays."""
    return df.where(~F.coalesce(contains_word_of(F.col(name), words), F.lit(False)))


def without_marker_words(df: DataFrame, text: str, words: Sequence[str] = SPANISH_MARKERS) -> DataFrame:
    """Rows whose text holds none of the words; null text drops."""
    return df.where(~F.coalesce(contains_word_of(F.col(text), words), F.lit(True)))


def with_all_words(df: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(text).contains(w) for w in words]))


def example_texts(df: DataFrame, text: str, words: Sequence[str], n: int = 5) -> DataFrame:
    """Up to ``n`` distinct texts holding all words, in text order."""
    return with_all_words(df, text, words).select(text).distinct().orderBy(text).limit(n)


def groups_where(df: DataFrame, key: str, *conditions: Column) -> DataFrame:
    """All rows of the groups that meet aggregate conditions; null keys drop."""
    flags = [c.alias(f"_c{i}") for i, c in enumerate(conditions)]
    chosen = df.groupBy(key).agg(*flags)
    for i in range(len(conditions)):
        chosen = chosen.where(F.col(f"_c{i}"))
    chosen = chosen.select(F.col(key).alias("_key"))
    return df.join(chosen, df[key] == chosen["_key"], "left_semi")


def most_frequent_per_group(df: DataFrame, key: str, value: str, count: str = "count_rows") -> DataFrame:
    """Values with the group's highest row count, ties kept."""
    counts = df.groupBy(key, value).agg(F.count("*").alias(count))
    best = counts.groupBy(F.col(key).alias("_key")).agg(F.max(count).alias("_best"))
    match = counts[key].eqNullSafe(best["_key"]) & (counts[count] == best["_best"])
    return counts.join(best, match).drop("_key", "_best")


def without_flat_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """Drop groups whose every value is zero."""
    flat = df.groupBy(F.col(key).alias("_key")).agg(
        F.bool_and(F.coalesce(F.col(value) == 0, F.lit(False))).alias("_flat")
    )
    flat = flat.where("_flat")
    return df.join(flat, df[key].eqNullSafe(flat["_key"]), "left_anti")


def counted_in_years(df: DataFrame, count: str, date: str, first: int, last: int) -> DataFrame:
    """Positive counts loaded in the closed span of years."""
    return df.where((F.col(count) > 0) & in_years(date, first, last))


def in_years(date: str, first: int, last: int) -> Column:
    """Whether a date lies in the closed span of years, as bounds that a scan can use."""
    day = F.col(date)
    return (day >= F.lit(datetime.date(first, 1, 1))) & (day < F.lit(datetime.date(last + 1, 1, 1)))


def with_status(df: DataFrame, status: str, kept: Sequence[str]) -> DataFrame:
    """Rows whose status tail is one of ``kept``."""
    return df.where(status_tail(F.col(status)).isin(list(kept)))


def split_by_rule(df: DataFrame, rule: Column, flag: str = "is_accurate") -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rejects); an unknown result is a reject."""
    marked = df.withColumn(flag, F.coalesce(rule, F.lit(False)))
    return marked.where(F.col(flag)), marked.where(~F.col(flag))
