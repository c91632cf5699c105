"""Quoted delimited files read in many tasks, line breaks in cells or not.

Spark cuts a file at line ends, which may lie inside a quoted cell. So quotes are
counted for every byte range first; their running sum tells whether a range begins
inside quotes. Then each range puts its lines together to records. What a range holds
before its first record, and what it leaves open at its end, are pieces of one record
each, joined afterwards; there are at most two for each range.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, start, line): the lines of the files by byte range, in order inside each."""
    text = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def quote_states(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """For each byte range with a line, whether it begins inside quotes.

    One row a range reaches the driver, which holds the list of ranges anyhow. A file
    whose quotes do not pair up is an error.
    """
    marks = F.length("line") - F.length(F.replace("line", F.lit(QUOTE), F.lit("")))
    counts = lines.groupBy("file", "start").agg(F.sum(marks).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    summed = counts.select("file", "start", "quotes", F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("before"))
    rows = summed.collect()
    last: dict[str, tuple[int, int]] = {}
    for r in rows:
        last[r["file"]] = max(last.get(r["file"], (-1, 0)), (r["start"], r["before"] + r["quotes"]))
    for file, (_, quotes) in last.items():
        if quotes % 2:
            raise ValueError(f"{file} has a quote without its pair")
    return {(r["file"], r["start"]): r["before"] % 2 == 1 for r in rows}


#: What a piece of text is: a whole record, the rest of an earlier range's record, the begin of one.
WHOLE, HEAD, TAIL = 0, 1, 2


def _pieces(lines: DataFrame, states: dict[tuple[str, int], bool]) -> DataFrame:
    """(file, start, place, kind, text): records and pieces of records of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        held: list[str] = []
        place, inside, kind = 0, False, WHOLE
        out: list[tuple] = []

        def close(final: int) -> None:
            nonlocal held, place, kind
            out.append((*at, place, kind if kind == HEAD else final, "\n".join(held)))
            held, place, kind = [], place + 1, WHOLE

        for batch in batches:
            files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            quotes = pc.count_substring(batch.column(2), QUOTE).to_pylist()
            for file, start, line, n in zip(files, starts, batch.column(2).to_pylist(), quotes):
                if at is None or (file, start) != at:
                    if held:
                        close(TAIL)
                    at, place, inside = (file, start), 0, states[(file, start)]
                    kind = HEAD if inside else WHOLE
                held.append(line)
                inside ^= n % 2 == 1
                if not inside:
                    close(WHOLE)
            if out:
                yield _batch(out)
                out = []
        if held:
            close(TAIL)
        if out:
            yield _batch(out)

    return lines.mapInArrow(run, "file string, start long, place long, kind int, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "start", "place", "kind", "text"])


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, start, place, text): every record of the files; ``start`` and ``place`` give their order.

    A range that begins and ends inside the same quotes is one piece as a whole: its
    head is not closed. All pieces of a record are numbered by the range that opened it.
    """
    lines = _lines(spark, path)
    found = _pieces(lines, quote_states(lines))
    whole = found.where(F.col("kind") == WHOLE).select("file", "start", "place", "text")
    pieces = found.where(F.col("kind") != WHOLE)
    # a record's pieces are its opening one and the heads that follow
    order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("kind") == TAIL, F.struct("start", "place")), ignorenulls=True).over(order)
    joined = pieces.withColumn("opened", opened).groupBy("file", "opened").agg(F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("all"))
    joined = joined.select("file", "opened.start", "opened.place", F.array_join(F.transform("all", lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined)


def read_split(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    blank_as_null: bool = True,
    sep: str = ",",
    **options,
) -> DataFrame:
    """Delimited files with a header row and quoted cells (RFC 4180), each in as many tasks as it has byte ranges.

    Without a schema all columns are text, named by the first file's header. Lines end
    with a line feed, with or without a carriage return. Quotes only stand around cells,
    doubled inside; line breaks in cells stay as they are; empty lines between records
    are left out. The files are read twice.
    """
    found = records(spark, path)
    if schema is None:
        heads = found.where((F.col("start") == 0) & (F.col("place") == 0)).orderBy("file").limit(1).collect()
        names = next(csv.reader([heads[0]["text"].removeprefix("﻿").removesuffix("\r")], delimiter=sep)) if heads else []
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    body = found.where((F.col("start") != 0) | (F.col("place") != 0))
    text = F.regexp_replace("text", r"\r\z", "")
    told = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true", "nullValue": "" if blank_as_null else "\u0000", **options}
    cells = body.select(text.alias("text")).where(F.col("text") != "")
    return cells.select(F.from_csv("text", _ddl(kinds), told).alias("cells")).select("cells.*")


def _ddl(kinds: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kinds)
