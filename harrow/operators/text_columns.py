"""Row-shape changes driven by text or date columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.dates import ordinal_day
from harrow.operators.aggregates import modes


def zip_split(df: DataFrame, separators: Mapping[str, str], names: Sequence[str]) -> DataFrame:
    """Split list columns on their own delimiters and pair the entries.

    Rows whose lists differ in length drop.
    """
    columns = list(separators)
    lists = [F.split(F.col(c), r"\Q" + sep + r"\E") for c, sep in separators.items()]
    same = F.lit(True)
    for other in lists[1:]:
        same = same & (F.size(lists[0]) == F.size(other))
    others = [c for c in df.columns if c not in columns]
    zipped = F.arrays_zip(*[a.alias(n) for a, n in zip(lists, names)])
    return df.where(same).select(*others, F.inline(zipped).alias(*names))


def ordinal_with_mode(df: DataFrame, date: str, out: str) -> DataFrame:
    """Day number of a date; a missing date takes the column's mode."""
    mode = modes(df, [], date, "_mode")
    filled = df.crossJoin(mode)  # one row
    return filled.withColumn(out, ordinal_day(F.coalesce(F.col(date), F.col("_mode")))).drop("_mode")
