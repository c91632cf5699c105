"""Column sets: compare, rename, stack and select.

Column names are driver-side metadata, so none of this runs a job except
``narrow_text_columns``, which counts distinct values in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)


def common_columns(tables: Sequence[DataFrame]) -> list[str]:
    """Columns every table has, in the first table's order."""
    shared = set.intersection(*[set(t.columns) for t in tables])
    return [c for c in tables[0].columns if c in shared]


def exclusive_columns(table: DataFrame, others: Iterable[DataFrame]) -> list[str]:
    seen = {c for t in others for c in t.columns}
    return [c for c in table.columns if c not in seen]


def new_columns(periods: Mapping[str, DataFrame]) -> list[tuple[str, str]]:
    """(period, column) for columns the period before did not have."""
    ordered = sorted(periods)
    return [
        (now, c)
        for before, now in zip(ordered, ordered[1:])
        for c in periods[now].columns
        if c not in periods[before].columns
    ]


def drift_report(spark: SparkSession, periods: Mapping[str, DataFrame]) -> DataFrame:
    """Per period and column: ``common``, ``new`` or ``kept`` against the period before."""
    shared = set(common_columns([periods[p] for p in sorted(periods)]))
    fresh = set(new_columns(periods))
    rows = [
        (p, c, "common" if c in shared else "new" if (p, c) in fresh else "kept")
        for p in sorted(periods)
        for c in periods[p].columns
    ]
    return spark.createDataFrame(rows, "period string, column string, status string")


def rename_known(df: DataFrame, *maps: Mapping[str, str]) -> DataFrame:
    """Apply rename maps in turn; names the table lacks are ignored."""
    return reduce(lambda d, m: d.withColumnsRenamed(dict(m)), maps, df)


def rename_periods(
    periods: Mapping[str, DataFrame],
    shared: Mapping[str, str],
    own: Mapping[str, Mapping[str, str]],
) -> dict[str, DataFrame]:
    """One map for all periods, then each period's own map."""
    return {p: rename_known(t, shared, own.get(p, {})) for p, t in periods.items()}


def rename_by_crosswalk(df: DataFrame, crosswalk: DataFrame, source: str) -> DataFrame:
    """Rename through the rows (source, old_name, new_name) of a crosswalk.

    Only rows whose old name is a column come to the driver, so the number
    fetched is bounded by the width of ``df``.
    """
    rows = crosswalk.where((F.col("source") == source) & F.col("old_name").isin(df.columns)).dropDuplicates(
        ["old_name"]
    )
    return rename_known(df, {r["old_name"]: r["new_name"] for r in rows.collect()})


def stack(tables: Sequence[DataFrame], fill: bool = True) -> DataFrame:
    """Union by column name; absent columns become null when ``fill``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), tables)


def stack_common(tables: Sequence[DataFrame]) -> DataFrame:
    names = common_columns(tables)
    return stack([t.select(*names) for t in tables], fill=False)


def with_source(df: DataFrame, label, column: str = "data_source") -> DataFrame:
    return df.withColumn(column, F.lit(label))


def stack_with_source(tables: Mapping[object, DataFrame], column: str = "data_source") -> DataFrame:
    return stack([with_source(t, label, column) for label, t in tables.items()])


def clean_name(name: str) -> str:
    """Trim, lower, spaces to ``_``, ``#`` to ``number``, other punctuation dropped."""
    name = re.sub(r"\s+", "_", name.strip().lower()).replace("#", "number")
    return re.sub(r"[^\w]", "", name)


def clean_names(df: DataFrame) -> DataFrame:
    """Clean every column name; a repeated result gets ``_2``, ``_3``, ..."""
    taken: set[str] = set()
    result = []
    for original in df.columns:
        base = clean_name(original)
        name, n = base, 1
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        result.append(name)
    return df.toDF(*result)


def columns_like(
    df: DataFrame, prefix: str = "", suffix: str = "", containing: str = "", pattern: str = ""
) -> list[str]:
    return [
        c
        for c in df.columns
        if c.startswith(prefix) and c.endswith(suffix) and containing in c and re.search(pattern, c)
    ]


def keep(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Listed columns the table has, in the table's order."""
    wanted = set(names)
    return df.select(*[c for c in df.columns if c in wanted])


def drop(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


DICTIONARY_TYPES = {"numeric": T.DoubleType(), "char": T.StringType(), "date": T.DateType()}


def schema_from_dictionary(entries: Iterable[tuple[str, str]]) -> T.StructType:
    """(name, type word) pairs, as in a data dictionary, to a read schema."""
    return T.StructType(
        [T.StructField(n.strip(), DICTIONARY_TYPES.get(k.strip().lower(), T.StringType())) for n, k in entries]
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def narrow_text_columns(df: DataFrame, most: int = 1000) -> list[str]:
    """Non-numeric columns with at most ``most`` distinct values."""
    names = text_columns(df)
    if not names:
        return []
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in names]).first()
    return [c for c in names if counts[c] <= most]
