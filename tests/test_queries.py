"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from workload.registry import TABLES, load

FOLDER = "/root/testdata/sf0.001"
ENTRIES = load()
NO_SQL = {name for name, e in ENTRIES.items() if not e.sql}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


def canonical(records):
    return sorted(tuple(shown(v) for v in r) for r in records)


@pytest.mark.parametrize("name", sorted(set(ENTRIES) - NO_SQL))
def test_query_agrees_with_sql(name, spark, duck):
    df = ENTRIES[name].run(spark, FOLDER)
    cursor = duck.execute(ENTRIES[name].sql)
    columns = [d[0] for d in cursor.description]
    right = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    left = [tuple(r) for r in df.select(*columns).collect()]
    assert canonical(left) == canonical(right)


def test_entry_is_lazy_and_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "employers", "with_case", "share"]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ENTRIES) <= set(entry.queries())
