"""Collects the workload's queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Attribute access to the driver's Parquet tables: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # long texts make for heavy rows
        return spread(table) if name in ("documents", "pages") else table


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    module: str


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None, days: str = ""):
    """Register ``fn(tables)`` under its own name; ``covers`` lists inventory ids.

    ``days`` names date columns: both sides give them as ``YYYY-MM-DD`` text, as
    the engines hand dates to Python in different types.
    """
    dated = days.split()
    if sql and dated:
        casts = ", ".join(f'"{c}"::DATE::VARCHAR AS "{c}"' for c in dated)
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"

    def register(fn):
        if fn.__name__ in ENTRIES:
            raise ValueError(f"query {fn.__name__} is defined twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return out.withColumns({c: F.col(c).cast("date").cast("string") for c in dated}) if dated else out

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        ENTRIES[fn.__name__] = Entry(fn.__name__, tuple(covers.split()), run, sql, fn.__module__.split('.')[-1])
        return fn

    return register


def load() -> dict[str, Entry]:
    from workload import MODULES as names

    for name in names:
        importlib.import_module(f"workload.{name}")
    return ENTRIES
