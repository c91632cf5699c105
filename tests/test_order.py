"""Scans over range slices against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import order


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    # one group holds well over a third of the rows
    data = [
        (i, None if i % 97 == 0 else ("hot" if rng.random() < 0.5 else f"g{rng.randint(0, 20)}"), rng.randint(0, 60), rng.choice([None, None, 1.5, 2.5]))
        for i in range(3000)
    ]
    return data, spark.createDataFrame(data, "id int, g string, v int, x double").repartition(5).cache()


def by_group(data):
    groups = {}
    for row in data:
        groups.setdefault(row[1], []).append(row)
    return groups


def test_positions(table):
    data, df = table
    want = {}
    for rows in by_group(data).values():
        for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
            want[r[0]] = n
    got = order.row_positions(df, [F.col("v").desc(), F.col("id").asc()], ["g"])
    assert {r["id"]: r["position"] for r in got.collect()} == want


def test_positions_of_whole_table_are_dense(table):
    _, df = table
    got = sorted(r["position"] for r in order.row_positions(df, [F.col("id").asc()]).collect())
    assert got == list(range(1, 3001))


def test_running_total(table):
    data, df = table
    want = {}
    for rows in by_group(data).values():
        total = 0
        for r in sorted(rows, key=lambda r: r[0]):
            total += r[2]
            want[r[0]] = total
    got = order.running_total(df, ["g"], [F.col("id").asc()], F.col("v"), "s")
    assert {r["id"]: r["s"] for r in got.collect()} == want


def test_average_rank(table):
    data, df = table
    want = {}
    for rows in by_group(data).values():
        values = [r[2] for r in rows]
        for r in rows:
            above = sum(v > r[2] for v in values)
            same = sum(v == r[2] for v in values)
            want[r[0]] = above + (same + 1) / 2
    got = order.average_rank(df, ["g"], "v")
    assert {r["id"]: r["rank"] for r in got.collect()} == want


def test_quantiles(table):
    import numpy as np

    data, df = table
    got = {r["g"]: r for r in order.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}).collect()}
    for g, rows in by_group(data).items():
        values = [r[2] for r in rows]
        assert abs(got[g]["a"] - np.quantile(values, 0.25)) < 1e-9
        assert abs(got[g]["b"] - np.quantile(values, 0.9)) < 1e-9


def test_fill_down_then_up_and_again(table):
    data, df = table
    want = {}
    for rows in by_group(data).values():
        rows = sorted(rows, key=lambda r: r[0])
        last = None
        down = []
        for r in rows:
            last = r[3] if r[3] is not None else last
            down.append(last)
        first = next((v for v in down if v is not None), None)
        for r, v in zip(rows, down):
            want[r[0]] = first if v is None else v
    once = order.fill_in_group(df, ["g"], [F.col("id").asc()], ["x"])
    assert {r["id"]: r["x"] for r in once.collect()} == want
    again = order.fill_in_group(once, ["g"], [F.col("id").asc()], ["x"])
    assert {r["id"]: r["x"] for r in again.collect()} == want
