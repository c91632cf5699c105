"""Writing results and reusing written stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells in quotes where needed, quotes doubled, white space at the ends kept.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_table(df: DataFrame, path: str, form: str = "parquet", **options) -> None:
    """CSV has a header; quotes are doubled and blanks kept, so cells read back as written."""
    if form == "csv":
        options = CSV_OPTIONS | options
    df.write.mode("overwrite").options(**options).format(form).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def has_output(spark: SparkSession, path: str) -> bool:
    """True when a finished write is at ``path`` (its success marker exists)."""
    return _exists(spark, f"{path}/_SUCCESS")


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
    """Read the stage at ``path`` if it is complete, else build, write and read it.

    An interrupted write leaves no success marker and is built again.
    """
    if not (reuse and has_output(spark, path)):
        write_table(build(), path)
    return spark.read.parquet(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder per key. No repartition: a large key is written by many tasks."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_sides(df: DataFrame, matched: Column, path: str) -> dict[str, str]:
    """Matched and unmatched rows in two tables; an unknown match is unmatched."""
    side = F.when(F.coalesce(matched, F.lit(False)), "matched").otherwise("unmatched")
    df.withColumn("_side", side).write.mode("overwrite").partitionBy("_side").parquet(path)  # the input runs once
    paths = {name: f"{path}/_side={name}" for name in ("matched", "unmatched")}
    for place in paths.values():
        if not _exists(df.sparkSession, place):
            write_table(df.limit(0), place)  # a side without rows is a table too
    return paths


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    return kind.load(path)
