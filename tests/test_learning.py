"""Text, space, features and models."""

import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from harrow.functions import geometry
from harrow.operators import features, models, spatial, text
from tests.helpers import one, rows


def test_preprocess(spark):
    df = spark.createDataFrame([(1, "The Workers' wages, 2020: working and paid_ly weekly"), (2, None), (3, "a of")], "i int, t string")
    stop = text.english_stopwords()
    got = {r["i"]: r["text_preprocess"] for r in text.preprocess(df, "t", stop).collect()}
    # a token with an underscore is not alphabetic
    assert got == {1: "worker wage work weekli", 2: "", 3: ""}


def test_words_from_corpus(spark):
    df = spark.createDataFrame([(1, "Work workers homework Networks rest"), (2, "working")], "i int, t string")
    assert sorted(one(text.words_matching(df, "t"))) == ["Networks", "homework", "workers", "working"]
    tokens = text.token_rows(df, "i", "t", lower=False)
    assert rows(text.without_words(tokens, text.words_matching(df, "t")), "token") == [("Work",), ("rest",)]


def test_removal_curve(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "a"), (4, "d")], "i int, t string")
    got = {r["threshold"]: (r["words"], r["tokens"], r["documents"]) for r in text.removal_curve(df, "i", "t", 3).collect()}
    assert got == {1: (3, 4, 1), 2: (3, 4, 1), 3: (4, 7, 4)}


def square(x, y, size):
    pts = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return [[{"x": float(a), "y": float(b)} for a, b in pts]]


def test_points_in_polygons(spark):
    hole = [{"x": 1.0, "y": 1.0}, {"x": 1.0, "y": 3.0}, {"x": 3.0, "y": 3.0}, {"x": 3.0, "y": 1.0}]
    shapes = [("big", square(0, 0, 4) + [hole]), ("right", square(4, 0, 2)), ("far", square(-10, -10, 1))]
    polygons = spark.createDataFrame(shapes, "area string, rings array<array<struct<x:double,y:double>>>")
    pts = [(1, 0.5, 0.5), (2, 4.0, 1.0), (3, 2.0, 2.0), (4, 0.0, 0.0), (5, 9.0, 9.0), (6, None, None), (7, -9.5, -9.5), (8, 3.0, 2.0)]
    points = spark.createDataFrame(pts, "i int, x double, y double")
    for cell in (None, 0.3, 100.0):
        got = rows(spatial.join_points(points, polygons, "x", "y", "rings", cell), "i", "area")
        assert got == [(1, "big"), (2, "big"), (2, "right"), (3, None), (4, "big"), (5, None), (6, None), (7, "far"), (8, "big")]


def star(rng, x, y, size, corners):
    """A ring around a point that winds in and out."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + size * r * math.cos(a), y + size * r * math.sin(a)) for a, r in ((a, rng.uniform(0.3, 1)) for a in turns)]


def inside(ring, x, y):
    """Even-odd rule with points on an edge inside, all edges looked at."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        odd ^= (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
    return odd


@pytest.mark.parametrize("together", [False, True])
def test_polygons_of_very_unequal_size(spark, together, monkeypatch):
    """One giant among small ones, some of many edges; points anywhere or all in one cell, on corners and on edges."""
    monkeypatch.setattr(spatial, "BROADCAST_EDGES", 10**6 if together else 0)
    rng = random.Random(3)
    shapes = [("giant", star(rng, 0, 0, 1000, 500)), ("box", [(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0)])]
    shapes += [(f"s{i}", star(rng, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(0.1, 3), rng.choice([3, 5, 40]))) for i in range(300)]
    shapes += [("dot", [(1.0, 1.0)]), ("none", [])]
    kind = "area string, rings array<array<struct<x:double,y:double>>>"
    polygons = spark.createDataFrame([(n, [[{"x": a, "y": b} for a, b in r]]) for n, r in shapes], kind)
    wide = 5 if together else 700
    pts = [(rng.uniform(-wide, wide), rng.uniform(-wide, wide)) for _ in range(400)] + [(1.0, 1.0), (500.0, 3.0), (-500.0, -500.0)]
    pts += [p for _, r in shapes[2:40] for p in r[:1]]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)] + [(-1, None, 2.0), (-2, 1.0, None)], "i int, x double, y double")
    want = [(i, n) for i, (x, y) in enumerate(pts) for n, r in shapes if r and inside(r, x, y)]
    want += [(i, None) for i in {-1, -2, *range(len(pts))} - {i for i, _ in want}]
    for edges in (64, 4):
        got = rows(spatial.join_points(points, polygons, "x", "y", "rings", edges_in_strip=edges), "i", "area")
        assert set(got) == set(want) and len(got) == len(want)


def test_polygons_meet_few_cells(spark):
    rng = random.Random(4)
    shapes = [("giant", star(rng, 0, 0, 1000, 500))] + [(f"s{i}", star(rng, rng.uniform(-900, 900), 0, 0.5, 5)) for i in range(200)]
    polygons = spark.createDataFrame([(n, [[{"x": a, "y": b} for a, b in r]]) for n, r in shapes], "area string, rings array<array<struct<x:double,y:double>>>")
    placed = polygons.select("area", geometry.edges(F.col("rings")).alias("_edges"), *[c.alias(f"_{n}") for n, c in geometry.bounds(F.col("rings")).items()])
    placed = placed.withColumn("_polygon", F.monotonically_increasing_id())
    side = F.greatest(F.col("_max_x") - F.col("_min_x"), F.col("_max_y") - F.col("_min_y"))
    filed = spatial._filed(placed, ["area"], side, 0.1, 64).groupBy("area").agg(F.count("*").alias("n"), F.max(F.size("_edges")).alias("most"))
    found = {r["area"]: (r["n"], r["most"]) for r in filed.collect()}
    assert all(n <= (4 * 8 if a == "giant" else 4) for a, (n, _) in found.items()) and found["giant"][1] < 250


def test_random_polygon_against_half_planes(spark):
    rng = random.Random(5)
    corners = [(math.cos(a), math.sin(a)) for a in sorted(rng.uniform(0, 2 * math.pi) for _ in range(9))]
    ring = F.array(*[geometry.point(F.lit(x), F.lit(y)) for x, y in corners])
    pts = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(500)]
    df = spark.createDataFrame(pts, "i int, x double, y double")
    inside = set(one(df.where(geometry.contains(geometry.edges(F.array(ring)), F.col("x"), F.col("y"))).select("i")))
    want = set()
    for i, x, y in pts:
        sides = [
            (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
            for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1])
        ]
        if all(sides):
            want.add(i)
    assert inside == want


def test_collapse_rare(spark):
    data = [(i, "a") for i in range(6)] + [(6, "b"), (7, None), (8, None), (9, None)]
    df = spark.createDataFrame(data, "g int, c string")
    got = rows(features.collapse_rare(df, "c", "g", 0.2).groupBy("c").count())
    assert got == [("OTHER", 1), ("a", 6), ("missing", 3)]


def test_group_split_never_straddles(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 200, F.lit(0)).otherwise(F.col("id") % 41))
    got = features.split_by_group(df, "g")
    assert got.count() == 500
    assert got.groupBy("g").agg(F.count_distinct("is_train").alias("n")).where("n > 1").count() == 0
    assert got.where("is_train").select("g").distinct().count() == math.floor(41 * 0.8)


def test_upsample_is_exact_and_repeatable(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    once = features.upsample(df, "y", 1, "id")
    assert rows(once.groupBy("y").count()) == [(0, 90), (1, 90)]
    assert rows(once) == rows(features.upsample(df.repartition(7), "y", 1, "id"))
    assert once.where("y = 1").select("id").distinct().count() <= 10


def test_imputing_and_dummies(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, None), (None, "a")], "x double, c string")
    test = spark.createDataFrame([(None, "zz")], "x double, c string")
    a, b = features.impute_mean(train, [test], ["x"])
    assert sorted(one(a.select("x"))) == [1.0, 2.0, 3.0] and one(b.select("x")) == [2.0]
    assert rows(features.impute_mode(train, ["c"]), "c") == [("a",)] * 3
    levels = {"c": features.levels_of(train, "c")}
    assert features.dummies(features.impute_constant(test, ["c"]), levels).columns == ["x", "c_a"]
    hot = features.one_hot(features.impute_constant(train, ["c"]), ["c"]).transform(test)
    assert hot.first()["c_hot"].toArray().sum() == 0.0
    assert features.drop_unusable(train.withColumn("e", F.lit(None).cast("int")), ["x"]).columns == ["c"]


def ring_data(spark, n=400):
    rng = random.Random(7)
    data = []
    for i in range(n):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        data.append((i, a, b, int(abs(a) < 0.6)))
    df = spark.createDataFrame(data, "id int, a double, b double, label int")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_estimators_and_tables(spark):
    df = ring_data(spark).cache()
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    chosen = models.estimators(train.count())
    assert list(chosen) == [
        "dt_shallow", "dt_deep", "random_forest_10020", "random_forest_100020", "gb_shallow", "gb_deep", "ada",
        "logit_l1_lowerpen", "logit_l2_lowerpen",
    ]
    out = models.estimate(
        {"dt_shallow": chosen["dt_shallow"], "ada": models.AdaBoost(rounds=12, keep_every=5), "logit": chosen["logit_l2_lowerpen"]},
        train, test, ["a", "b"], ["id"],
    )
    evals = {r["model"]: r for r in out["evals"].collect()}
    # a band needs two cuts: boosting finds both, a line cannot
    assert evals["dt_shallow"]["accuracy"] > 0.95
    assert evals["ada"]["accuracy"] > 0.9 > evals["logit"]["accuracy"]
    assert out["predictions"].count() == 3 * test.count()
    assert out["confusion"].groupBy("model").agg(F.sum("n").alias("n")).select("n").distinct().collect()[0][0] == test.count()
    top = {r["model"]: r["coef_name"] for r in out["importances"].orderBy("value").collect()}
    assert top["dt_shallow"] == top["ada"] == "a"


def test_scores_against_hand_counts(spark):
    df = spark.createDataFrame([("m", 1, 1), ("m", 1, 0), ("m", 0, 1), ("m", 0, 0), ("m", 1, 1), ("n", 0, 0)], "model string, predicted int, actual int")
    got = {r["model"]: tuple(r)[1:] for r in models.scores(df).collect()}
    assert got["m"] == (0.6, 2 / 3, 2 / 3, 2 / 3)
    assert got["n"] == (1.0, 0.0, 0.0, 0.0)


def test_two_way_effects_on_an_unbalanced_panel(spark):
    import numpy as np

    rng = random.Random(3)
    data = []
    for u in range(8):
        for p in range(6):
            if rng.random() < 0.8:
                x = rng.uniform(0, 5) + u
                data.append((u, p, x, 2.5 * x + 3 * u - p + rng.gauss(0, 0.5)))
    got = models.two_way_effects(spark.createDataFrame(data, "u int, p int, x double, y double"), "u", "p", "x", "y").first()
    n = len(data)
    design = np.zeros((n, 1 + 8 + 5))
    for i, (u, p, x, _) in enumerate(data):
        design[i, 0] = x
        design[i, 1 + u] = 1
        if p:
            design[i, 8 + p] = 1
    y = np.array([r[3] for r in data])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    residual = y - design @ beta
    freedom = n - 14
    error = math.sqrt(residual @ residual / freedom * np.linalg.inv(design.T @ design)[0, 0])
    assert abs(got["slope"] - beta[0]) < 1e-6
    assert abs(got["std_error"] / error - 1) < 0.05


def panel(kind):
    rng = random.Random(8)
    links = {
        "connected": [(u, p) for u in range(40) for p in range(12) if rng.random() < 0.4],
        "in two parts": [(u, p) for u in range(40) for p in range(12) if u % 2 == p % 2 and rng.random() < 0.5],
        "one row a unit": [(u, u % 9) for u in range(60)] + [(0, p) for p in range(9)] + [(1, 3)],
        "repeated cells": [(rng.randrange(6), rng.randrange(25)) for _ in range(300)],
        "a chain": [(u, p) for u in range(15) for p in (u, u + 1)] + [(0, 5), (3, 3)],
    }[kind]
    data = []
    for u, p in links:
        x = rng.uniform(0, 5) + u + 1000
        data.append((u, p, x, 2.5 * x + 3 * u - p + rng.gauss(0, 0.5)))
    return data


@pytest.mark.parametrize("kind", ["connected", "in two parts", "one row a unit", "repeated cells", "a chain"])
def test_two_way_effects_equal_dense_least_squares(spark, kind, monkeypatch):
    import numpy as np

    data, kept = panel(kind), []
    cut = models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: kept.append(1) or cut(df))
    got = models.two_way_effects(spark.createDataFrame(data, "u int, p int, x double, y double"), "u", "p", "x", "y").first()
    units, periods = sorted({r[0] for r in data}), sorted({r[1] for r in data})
    dummies = np.zeros((len(data), len(units) + len(periods)))
    for i, (u, p, *_) in enumerate(data):
        dummies[i, units.index(u)] = dummies[i, len(units) + periods.index(p)] = 1
    x, y = (np.array([r[c] for r in data]) - 1000 for c in (2, 3))
    x, y = (v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0] for v in (x, y))
    assert abs(got["slope"] - x @ y / (x @ x)) < 1e-9 and got["n"] == len(data)
    assert len(kept) - 2 < 30


def test_trends_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(6)
    data = [(float(rng.randrange(1, 51)), round(rng.uniform(900, 90000), 2)) for _ in range(3000)]
    seen = set()
    for seed in range(5):
        rng.shuffle(data)
        df = spark.createDataFrame(data, "x double, y double").repartition(1 + seed)
        seen.add(tuple(sorted(map(tuple, models.binned_trend(df, "x", "y").collect()))))
    assert len(seen) == 1


def test_smoothed_trend_follows_a_line_and_flat_data(spark):
    line = spark.createDataFrame([(float(i), 3.0 * i - 7) for i in range(500)], "x double, y double")
    out = models.smoothed_trend(line, "x", "y").collect()
    assert len(out) == 20 and all(abs(r["smooth"] - (3 * r["center"] - 7)) < 1e-6 for r in out)
    flat = spark.createDataFrame([(1.0, float(i % 2)) for i in range(400)], "x double, y double")
    assert all(0 <= r["smooth"] <= 1 for r in models.smoothed_trend(flat, "x", "y").collect())
