"""Reading period files, sheets, lookups and nested responses.

Cells may be quoted and then hold separators, doubled quotes and line breaks
(RFC 4180). Spark's reader does not split a file whose cells may hold line
breaks; ``split=True`` reads it in many tasks all the same, and
``multiLine=False`` does for files without them.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.sources.split_csv import read_split

#: How quoted cells are written and read back.
QUOTING = {"quote": '"', "escape": '"'}


def _options(options: dict) -> dict:
    return {"header": True, "multiLine": True, **QUOTING, **options}


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    blank_as_null: bool = True,
    split: bool = False,
    **options,
) -> DataFrame:
    """Delimited text with a header row.

    Without a schema the types are inferred, which reads the input twice; give
    one for large inputs. Blank cells read as null unless told otherwise. With
    ``split`` a file is read by byte ranges (``split_csv.read_split``), its
    columns as text if no schema is given.
    """
    if split:
        return read_split(spark, path, schema, blank_as_null, **options)
    reader = spark.read.option("nullValue", "" if blank_as_null else "\u0000").options(**_options(options))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_with_types(spark: SparkSession, path: str, types: dict[str, str], **options) -> DataFrame:
    """All columns as text but the ones given a type; junk becomes null."""
    df = spark.read.options(**_options(options)).csv(path)
    return df.select(
        *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    )


def source_file() -> Column:
    return F.col("_metadata.file_name")


def source_folder() -> Column:
    """Name of the folder that holds the file, for outputs written as folders."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def _headers(spark: SparkSession, glob: str, separator: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a glob, folders opened, by their header row. Only first lines are read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(glob)
    system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    open_, found = list(system.globStatus(pattern) or []), defaultdict(list)
    while open_:
        status = open_.pop()
        place = status.getPath()
        if place.getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            open_.extend(system.listStatus(place))
        elif status.getLen():
            java = spark.sparkContext._jvm.java.io
            lines = java.BufferedReader(java.InputStreamReader(system.open(place), "UTF-8"))
            try:
                first = lines.readLine()
            finally:
                lines.close()
            found[tuple(next(csv.reader([first.removeprefix("\ufeff")], delimiter=separator)))].append(place.toString())
    return dict(found)


def read_by_header(spark: SparkSession, glob: str, schema: T.StructType | str, **options) -> list[DataFrame]:
    """All files of a glob, one table for each distinct header, columns taken by name.

    Each table has the columns of ``schema`` in their order and the file's metadata.
    Columns beyond the schema are left out; a header without one of the schema's
    raises. No file gives one empty table.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kinds = {f.name: f for f in wanted}
    tables = []
    for header, paths in sorted(_headers(spark, glob, options.get("sep", ",")).items()):
        absent = [c for c in kinds if c not in header]
        if absent:
            raise ValueError(f"{paths[0]} has no column {', '.join(absent)}")
        names = [c if c in kinds and c not in header[:i] else f"_unread_{i}" for i, c in enumerate(header)]
        found = T.StructType([kinds.get(c) or T.StructField(c, T.StringType()) for c in names])
        read = spark.read.options(**_options(options)).option("enforceSchema", True).schema(found).csv(paths)
        tables.append(read.select(*kinds, F.col("_metadata").alias("_metadata")))
    if not tables:
        place = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("file_name", T.StringType())])
        tables.append(spark.createDataFrame([], T.StructType([*wanted, T.StructField("_metadata", place)])))
    return tables


def _stacked(tables: list[DataFrame], *added: Column) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(*[c for c in t.columns if c != "_metadata"], *added) for t in tables])


def period_names(pattern: str, months: Sequence[str], years: Sequence[int]) -> list[tuple[str, int, str]]:
    """(file name, year, month) for every year and month of a name pattern."""
    return [(pattern.format(mon=m, year=y), y, m) for y, m in product(years, months)]


def read_periods(
    spark: SparkSession, glob: str, schema: T.StructType | str, year: str = "year", pattern: str = r"20[0-9]{2}", **options
) -> DataFrame:
    """All files of a glob, columns by name, the year taken from each file's name,
    or from its folder's when the file's own has none."""
    own = F.regexp_extract(source_file(), pattern, 0)
    outer = F.regexp_extract(source_folder(), pattern, 0)
    found = F.when(source_file().startswith("part-") | (own == ""), outer).otherwise(own)
    return _stacked(read_by_header(spark, glob, schema, **options), F.when(found != "", found).cast("int").alias(year))


def read_quarters(spark: SparkSession, glob: str, schema: T.StructType | str, **options) -> DataFrame:
    """Files named ``..._<MON><YEAR>.<ext>``, or in folders named so: adds YEAR and QUARTER."""
    name = F.when(source_file().startswith("part-"), F.concat(source_folder(), F.lit("."))).otherwise(source_file())
    return _stacked(
        read_by_header(spark, glob, schema, **options),
        F.regexp_extract(name, r"_[A-Z]{3}([0-9]{4})\.", 1).try_cast("int").alias("YEAR"),
        F.regexp_extract(name, r"_([A-Z]{3})[0-9]{4}\.", 1).alias("QUARTER"),
    )


def read_sheets(
    spark: SparkSession, glob: str, schema: T.StructType | str, index_pattern: str = r"^(Unnamed.*|_c0)$", **options
) -> DataFrame:
    """A workbook exported as one file or folder per sheet: stacked by column name,
    the sheet's name kept, index columns dropped."""
    own = F.regexp_extract(source_file(), r"^(.*)\.[^.]+$", 1)
    sheet = F.when(source_file().startswith("part-"), source_folder()).otherwise(own)
    return without_index_columns(_stacked(read_by_header(spark, glob, schema, **options), sheet.alias("sheet")), index_pattern)


def without_index_columns(df: DataFrame, index_pattern: str = r"^(Unnamed.*|_c0)$") -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(index_pattern, c)])


def stamp_snapshot(df: DataFrame, name: Column, column: str = "current_asof") -> DataFrame:
    """Snapshot date from eight digits in a source name, as a date."""
    digits = F.regexp_extract(name, r"([0-9]{8})", 1)
    return df.withColumn(column, F.try_to_date(digits, "yyyyMMdd"))


def flagged_entries(codebook: DataFrame, flag: str, yes: str = "yes") -> DataFrame:
    return codebook.where(F.lower(F.trim(F.col(flag))) == yes)


def entries_with_column(codebook: DataFrame, name: str, columns: Sequence[str], suffix: str = "E") -> DataFrame:
    """Codebook rows whose name plus suffix is one of the data's columns."""
    return codebook.where(F.concat(F.col(name), F.lit(suffix)).isin(list(columns)))


GEOCODE_RESPONSE = "results array<struct<accuracy:double,accuracy_type:string,location:struct<lat:double,lng:double>>>"


def first_geocode(df: DataFrame, response: str) -> DataFrame:
    """First result of a geocoding response; null fields on any miss."""
    parsed = F.from_json(F.col(response), GEOCODE_RESPONSE)
    first = F.get(parsed["results"], F.lit(0))
    return df.select(
        "*",
        first["location"]["lat"].alias("geo_lat"),
        first["location"]["lng"].alias("geo_long"),
        first["accuracy"].alias("geo_accuracy"),
        first["accuracy_type"].alias("geo_accuracy_type"),
    )


def json_field(c: Column, path: str, kind: str) -> Column:
    """A nested field as ``kind``; null when absent or malformed."""
    return F.get_json_object(c, path).try_cast(kind)


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per anchor of a page: ``href`` and ``anchor`` text.

    Letter case of the markup does not matter; addresses may stand in double quotes, in
    single ones or in none.
    """
    anchor = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>(.*?)</a\s*>"""
    address = F.transform(
        F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(1)), lambda x: F.regexp_replace(x, r"""^["']|["']$""", "")
    )
    pairs = F.arrays_zip(
        address.alias("href"),
        F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(2)).alias("anchor"),
    )
    others = [c for c in pages.columns if c != html]
    return pages.select(*others, F.inline(pairs).alias("href", "anchor"))


def select_links(
    links: DataFrame, href_like: str = "", anchor_has: str = "", anchor_lacks: str = "", base: str = ""
) -> DataFrame:
    """Links by address pattern and anchor text, with a base address put in front."""
    chosen = links
    if href_like:
        chosen = chosen.where(F.col("href").rlike(href_like))
    if anchor_has:
        chosen = chosen.where(F.col("anchor").contains(anchor_has))
    if anchor_lacks:
        chosen = chosen.where(~F.col("anchor").contains(anchor_lacks))
    return chosen.withColumn("link", F.concat(F.lit(base), F.col("href")))
