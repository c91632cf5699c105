import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harrow.functions.similarity import jaro_winkler, jaro_winkler_pairs
from harrow.operators import candidates, joins, linkage, prefix_keys
from tests.helpers import one, rows


def jw(a, b):
    """Textbook Jaro-Winkler."""
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    m, t = len(left), sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    head = 0
    while head < min(4, len(a), len(b)) and a[head] == b[head]:
        head += 1
    return jaro + head * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def names(n, seed=1, longest=14, letters="ABCDE "):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_kernel_matches_textbook():
    a, b = names(3000, 1), names(3000, 2)
    got = jaro_winkler_pairs(a, b)
    assert all(abs(g - jw(x, y)) < 1e-12 for g, x, y in zip(got, a, b))


@pytest.mark.parametrize("longest", [10, 63, 64, 65, 130])
def test_close_pairs_are_all_pairs_above_the_cut(longest):
    left, right = names(70, 3, longest), names(90, 4, longest)
    left += [s[:-1] + "X" for s in right[:20]] + right[20:40]
    for cut in (0.7, 0.85, 0.94):
        rows_, cols, scores = candidates.close_pairs(left, right, cut)
        got = {(i, j): s for i, j, s in zip(rows_.tolist(), cols.tolist(), scores.tolist())}
        want = {(i, j): jw(x, y) for i, x in enumerate(left) for j, y in enumerate(right) if jw(x, y) >= cut}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def long_titles(n, seed):
    """Titles of frequent syllables, as pages have them: long, of few letters and alike by chance."""
    rng = random.Random(seed)
    return list(dict.fromkeys(" ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(12))[:60] for _ in range(n)))


SYLLABLES = "THE AN ION ER ST HA OU ED RE ING ND TI".split()


@pytest.mark.parametrize("cut", [0.7, 0.8, 0.88])
def test_close_pairs_of_alike_titles(cut):
    left, right = long_titles(60, 1), long_titles(700, 2) + ["THE", "A", "T" * 64, "X" * 65]
    left += [s[:-2] + "XY" for s in right[:9]] + ["T" * 63, "\u2603" * 5]
    want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if jw(x, y) >= cut}
    got = candidates.close_pairs(left, right, cut)
    assert set(zip(got[0].tolist(), got[1].tolist())) == want and len(got[0]) == len(want)
    for parts in (candidates.close_parts(left, right, cut), candidates._in_pieces(candidates.close_parts(left, right, cut))):
        assert sum(len(p[0]) for p in parts) == len(want)
    within = {(i, j) for parts in candidates.close_within(right, cut) for i, j in zip(parts[0].tolist(), parts[1].tolist())}
    assert within == {(i, j) for i, x in enumerate(right) for j, y in enumerate(right) if i < j and jw(x, y) >= cut}


def test_similarity_column_nulls_and_equality(spark):
    df = spark.createDataFrame([("AB", "AB"), (None, "A"), ("A", None), ("AB", "XY")], "a string, b string")
    assert one(df.select(jaro_winkler(F.col("a"), F.col("b")))) == [1.0, None, None, 0.0]


def test_tiles_give_the_same_pairs_as_one_task(spark):
    values = list(dict.fromkeys(names(400, 5)))
    data = [("tx" if i % 3 else "hot", v) for i, v in enumerate(values)] + [("tx", values[0]), (None, "ABC"), ("tx", None), ("tx", "")]
    df = spark.createDataFrame(data, "state string, name string")
    want = set()
    distinct = {(s, n) for s, n in data if s and n}
    for s, a in distinct:
        for r, b in distinct:
            if s == r and a < b and jw(a, b) >= 0.85:
                want.add((s, a, b))
    for tile in (16, 1000):
        got = candidates.similar_values(df, None, ["state"], "name", 0.85, tile=tile)
        assert {(r["state"], r["left_value"], r["right_value"]) for r in got.collect()} == want
    assert got.count() == len(want)


def odd_words(n, seed, letters="aab"):
    """Short words of few letters, so that letters repeat and similar words abound."""
    rng = random.Random(seed)
    return list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(n)))


@pytest.mark.parametrize("cut", [0.7, 0.8, 0.85, 0.94])
def test_similar_values_share_a_key(cut):
    factors = [candidates.overlap_factor(cut, h) for h in range(5)]
    words = odd_words(120, 1) + odd_words(120, 2, "abcdefgh") + list(dict.fromkeys(names(120, 3, 30))) + ["a" * 50, "a" * 49 + "b", "ab" * 45]
    ranks = {c: i for i, c in enumerate("hgfedcba")}
    keys = {w: [prefix_keys.keys_of(w, factors, lambda c: ranks.get(c, 0), longer) for longer in (False, True)] for w in set(words)}
    close = 0
    for x in keys:
        for y in keys:
            if len(x) <= len(y) and jw(x, y) >= cut:
                close += 1
                assert keys[x][0] & keys[y][1], (x, y)
    assert close > len(keys)  # each is like itself


@pytest.mark.parametrize("cut,tile", [(0.85, 1024), (0.94, 8)])
def test_large_blocks_give_the_same_pairs_by_keys(spark, cut, tile):
    values = list(dict.fromkeys(odd_words(150, 4, "abc") + names(200, 5) + ["X" * 60, "X" * 59 + "Y"]))
    data = [("tx" if i % 4 else "hot", v) for i, v in enumerate(values)] + [("tx", values[0]), (None, "ABC"), ("tx", None), ("tx", "")]
    df = spark.createDataFrame(data, "state string, name string")
    one_way = candidates.similar_values(df, None, ["state"], "name", cut, tile=1000)
    keyed = candidates.similar_values(df, None, ["state"], "name", cut, tile=tile, dealt=0)
    want = rows(one_way.withColumn("similarity", F.round("similarity", 9)), "state", "left_value", "right_value", "similarity")
    assert rows(keyed.withColumn("similarity", F.round("similarity", 9)), *one_way.columns) == want and want
    # one block is large enough, the other is not
    mixed = candidates.similar_values(df, None, ["state"], "name", cut, tile=64, dealt=6)
    assert rows(mixed.withColumn("similarity", F.round("similarity", 9)), *one_way.columns) == want


def test_large_blocks_go_by_keys_only_if_few_values_meet(spark, monkeypatch):
    monkeypatch.setattr(candidates, "TRIED", 100)
    ways = []
    by_keys = candidates._keyed_pairs
    monkeypatch.setattr(candidates, "_keyed_pairs", lambda *a: ways.append(a[0].count()) or by_keys(*a))
    rng = random.Random(6)
    short = ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(14)) for _ in range(500)]
    data = [("long", v) for v in long_titles(400, 3)] + [("short", v) for v in dict.fromkeys(short + [s[:-1] for s in short[:30]])]
    df = spark.createDataFrame(data, "state string, name string")
    want = rows(candidates.similar_values(df, None, ["state"], "name", 0.94, tile=1000).drop("similarity"))
    assert rows(candidates.similar_values(df, None, ["state"], "name", 0.94, tile=32, dealt=4).drop("similarity")) == want and len(want) > 20
    assert ways == [530]


def test_keys_leave_a_task_in_small_batches(spark):
    df = spark.createDataFrame([(v,) for v in long_titles(900, 4)], "_value string")
    sizes = []

    class Rows:
        """Stands in for a table of one batch."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pydict({"_value": [r[0] for r in df.collect()]})
            sizes.extend(b.num_rows for b in run([batch]))
            return df

    candidates._key_maker(df, [], 0.8)(Rows(), True)
    assert max(sizes) < 2 * candidates.PART and sum(sizes) > 4 * candidates.PART


def test_two_large_tables_without_block(spark):
    x, y = odd_words(80, 6, "abcd") + names(60, 6), odd_words(80, 7, "abcd") + names(60, 7)
    a, b = (spark.createDataFrame([(n,) for n in v], "name string") for v in (x, y))
    got = candidates.similar_values(a, b, [], "name", 0.8, dealt=0)
    assert {(r["left_value"], r["right_value"]) for r in got.collect()} == {(p, q) for p in x for q in y if jw(p, q) >= 0.8}


def test_keys_of_a_value_depend_on_its_length_only():
    factors = [candidates.overlap_factor(0.85, h) for h in range(5)]
    most = [max(len(prefix_keys.keys_of(w, factors, ord, longer)) for w in names(50, 9, 24)) for longer in (False, True)]
    assert most[0] < 200 and most[1] < 3000


def test_spanning_pairs_give_the_same_groups(spark):
    family = [f"GREEN VALLEY FARM NUMBER {i}" for i in range(60)]
    df = spark.createDataFrame([("tx", v) for v in family + names(80, 11)], "state string, name string")
    full = candidates.similar_values(df, None, ["state"], "name", 0.9, tile=25)
    few = candidates.similar_values(df, None, ["state"], "name", 0.9, tile=25, spanning=True)
    assert few.count() < full.count()
    nodes = df.select(F.col("name").alias("node"))
    groups = [
        rows(linkage.connected_groups(nodes, e, a="left_value", b="right_value"), "node", "group") for e in (full, few)
    ]
    assert groups[0] == groups[1]


def test_linked_values_are_not_compared_again(spark, monkeypatch):
    """Values that small tiles link go into one group; then only others are compared."""
    groups = [long_titles(900, 5), ["QQQQ", "QQQQQ", "VVVVVV", "VVVVVW", "WWWW"]]
    df = spark.createDataFrame([("en", v) for v in groups[0] + groups[1]] + [("de", v) for v in groups[0][:40]], "state string, name string")
    full = candidates.similar_values(df, None, ["state"], "name", 0.75, tile=1000)
    settled = []
    tiles = candidates._tile_pairs

    def seen(a, *args, **options):
        if "_largest" in a.columns:
            settled.append((a.count(), a.where("_largest").count()))
        return tiles(a, *args, **options)

    monkeypatch.setattr(candidates, "_tile_pairs", seen)
    few = candidates.similar_values(df, None, ["state"], "name", 0.75, tile=60, spanning=True)

    def grouped(pairs):
        nodes = df.select(F.concat_ws(" ", "state", "name").alias("node"))
        return rows(linkage.connected_groups(nodes, pairs.select(F.concat_ws(" ", "state", "left_value").alias("a"), F.concat_ws(" ", "state", "right_value").alias("b"))))

    assert grouped(few) == grouped(full)
    assert settled and settled[0][1] > 0.9 * settled[0][0]
    assert few.count() < full.count() / 4


def test_two_tables_without_block(spark):
    a = spark.createDataFrame([(n,) for n in names(60, 6)], "name string")
    b = spark.createDataFrame([(n,) for n in names(60, 7)], "name string")
    got = candidates.similar_values(a, b, [], "name", 0.8, tile=13)
    x, y = {r[0] for r in a.collect()}, {r[0] for r in b.collect()}
    want = {(p, q) for p in x for q in y if jw(p, q) >= 0.8}
    assert {(r["left_value"], r["right_value"]) for r in got.collect()} == want


def people(spark, n, seed, id_name):
    rng = random.Random(seed)
    firsts = names(25, 8, 12, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    cities = names(8, 9, 9, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    data = []
    for i in range(n):
        name, city = rng.choice(firsts), rng.choice(cities + [None])
        data.append((i, rng.choice(["TX", "TX", "GA"]), name + rng.choice(["", "", "X"]) if rng.random() > 0.05 else None, city))
    return data, spark.createDataFrame(data, f"{id_name} int, state string, name string, city string")


def level(a, b):
    if a is None or b is None:
        return -1
    s = jw(a, b)
    return 2 if s >= 0.94 else 1 if s >= 0.88 else 0


def test_pattern_counts_cover_all_pairs(spark):
    ldata, left = people(spark, 60, 1, "i")
    rdata, right = people(spark, 50, 2, "j")
    want = {}
    for _, s, n, c in ldata:
        for _, t, m, d in rdata:
            if s == t:
                k = (level(n, m), level(c, d))
                want[k] = want.get(k, 0) + 1
    fields = ["name", "city"]
    got = linkage.pattern_counts(
        linkage.combinations(left, ["state"], fields), linkage.combinations(right, ["state"], fields), ["state"], fields
    )
    assert {(r["level_name"], r["level_city"]): r["pairs"] for r in got.collect()} == want


def test_self_pattern_counts_cover_all_pairs(spark):
    data, df = people(spark, 80, 3, "i")
    want = {}
    for i, (_, s, n, c) in enumerate(data):
        for _, t, m, d in data[i + 1 :]:
            if s == t:
                k = (level(n, m), level(c, d))
                want[k] = want.get(k, 0) + 1
    got = linkage.pattern_counts(linkage.combinations(df, ["state"], ["name", "city"]), None, ["state"], ["name", "city"])
    assert {(r["level_name"], r["level_city"]): r["pairs"] for r in got.collect()} == want


def test_fitted_model_finds_planted_matches():
    patterns = [
        ({"name": 2, "city": 2}, 90.0), ({"name": 2, "city": 0}, 10.0), ({"name": 1, "city": 2}, 12.0),
        ({"name": 0, "city": 2}, 5000.0), ({"name": 0, "city": 0}, 95000.0), ({"name": 0, "city": 1}, 500.0),
        ({"name": 2, "city": -1}, 20.0),
    ]
    model = linkage.fit_link_model(patterns)
    assert model.posterior({"name": 2, "city": 2}) > 0.95
    assert model.posterior({"name": 0, "city": 2}) < 0.05
    assert model.posterior({"name": 0, "city": 0}) < 0.001


def test_chance_agreement_gives_no_matches():
    # name and city agree together exactly as often as independence says
    n, a, c = 1_000_000, 0.01, 0.05
    patterns = [
        ({"name": 2, "city": 2}, n * a * c), ({"name": 2, "city": 0}, n * a * (1 - c)),
        ({"name": 0, "city": 2}, n * (1 - a) * c), ({"name": 0, "city": 0}, n * (1 - a) * (1 - c)),
    ]
    model = linkage.fit_link_model(patterns)
    assert all(model.posterior(p) < 0.85 for p, _ in patterns)


def test_link_tables_one_to_one_and_keeps_left(spark):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    real = [(names(1, 100 + i, 14, letters)[0] + "FARM", names(1, 500 + i, 10, letters)[0] + "TOWN") for i in range(60)]
    left = [(i, "TX", n, c) for i, (n, c) in enumerate(real)]
    right = [(1000 + i, "TX", n[:-1] if rng.random() < 0.3 else n, c) for i, (n, c) in enumerate(real[:40])]
    a = spark.createDataFrame(left, "l int, state string, name string, city string")
    b = spark.createDataFrame(right, "r int, state string, name string, city string")
    got = linkage.link_tables(a, b, "l", "r", ["state"], ["name", "city"]).collect()
    assert len(got) == 60
    links = [(r["l"], r["r"]) for r in got if r["is_matched"]]
    assert len({x for x, _ in links}) == len(links) == len({y for _, y in links})
    assert all(y - 1000 == x for x, y in links) and len(links) >= 36


def test_similar_values_of_a_field_are_found_once(spark, monkeypatch):
    """The steps of a linkage read the same similar values; missing names and cities do not change that."""
    found = []
    plain = linkage.similar_values
    monkeypatch.setattr(linkage, "similar_values", lambda *a, **k: found.append(a[3]) or plain(*a, **k))
    named = [(i, "TX", n if i % 7 else None, n[::-1] if i % 5 else None) for i, n in enumerate(names(60, 8, 12, "ABCDEFGHIJ"))]
    df = spark.createDataFrame(named + [(100 + i, "TX", n, c) for i, _, n, c in named], "l int, state string, name string, city string")
    linkage.linked_combinations(df, None, ["state"], ["name", "city"]).count()
    assert sorted(found) == ["city", "name"]


def test_nothing_in_common_links_nothing(spark):
    a = spark.createDataFrame([(1, "TX", "ABCDEF", "QQQQ"), (2, "TX", "GHIJKL", "RRRR")], "l int, state string, name string, city string")
    b = spark.createDataFrame([(1, "TX", "MNOPZZ", "SSSS"), (2, "TX", "UUVVWW", "TTTT")], "r int, state string, name string, city string")
    got = linkage.link_tables(a, b, "l", "r", ["state"], ["name", "city"])
    assert rows(got, "l", "r", "is_matched") == [(1, None, False), (2, None, False)]


def test_connected_groups_are_components(spark):
    rng = random.Random(4)
    nodes = [f"n{i:03d}" for i in range(150)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(110)] + [(nodes[i], nodes[i + 1]) for i in range(40)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        p, q = find(x), find(y)
        parent[max(p, q)] = min(p, q)
    want = {n: find(n) for n in nodes}
    got = linkage.connected_groups(
        spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string")
    )
    assert {r["node"]: r["group"] for r in got.collect()} == want


@pytest.mark.parametrize("removed, cases, want", [(12, 1, 13), (8, 1, 9), (24, 11, 275), (7, 0, 8)])
def test_re_expansion_arithmetic(spark, removed, cases, want):
    jobs = spark.createDataFrame([(i, "j") for i in range(removed + 1)], "job_row int, job_group string")
    case = spark.createDataFrame([(i, "c") for i in range(cases)] + [(99, "other")], "case_row int, case_group string")
    # a link listed twice must not count twice
    links = spark.createDataFrame([("j", "c"), ("j", "c")] if cases else [("k", "c")], "job_group string, case_group string")
    got = linkage.expand_matches(jobs, case, links, "job_group", "case_group")
    assert got.count() == want
    assert {r["is_matched"] for r in got.collect()} == {cases > 0}


def test_re_expansion_does_not_shuffle_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins.join_many, "__defaults__", ("left", 500))
    jobs = spark.createDataFrame([(i, f"j{i % 3}") for i in range(60)] + [(99, None)], "job_row int, job_group string")
    cases = spark.createDataFrame([(i, "c" if i else "d") for i in range(300)], "case_row int, case_group string")
    links = spark.createDataFrame([("j0", "c"), ("j0", "d"), ("j1", "no cases"), (None, "c"), ("j2", None)], "job_group string, case_group string")
    got = linkage.expand_matches(jobs, cases, links, "job_group", "case_group")
    assert got.columns == ["job_group", "job_row", "case_group", "case_row", "is_matched"]
    want = [("j0", j, "c" if c else "d", c, True) for j in range(0, 60, 3) for c in range(300)]
    want += [(f"j{i % 3}", i, None, None, False) for i in range(60) if i % 3] + [(None, 99, None, None, False)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    # pairs are made where they stay: the rows of one job group lie in many tasks
    assert got.where("job_group = 'j0'").groupBy(F.spark_partition_id()).count().count() > 5


def test_blank_names_get_no_group(spark):
    df = spark.createDataFrame([(1, "TX", "GREEN FARM"), (2, "TX", "GREEN FARMS"), (3, "TX", None), (4, "GA", "GREEN FARM")], "i int, state string, name string")
    got = {r["i"]: r["group"] for r in linkage.dedupe_values(df, "name", ["state"]).collect()}
    assert got == {1: "GREEN FARM", 2: "GREEN FARM", 3: None, 4: "GREEN FARM"}


def groups_of(spark, nodes, edges, **options):
    n, e = spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")
    return dict(rows(linkage.connected_groups(n, e, **options), "node", "group"))


def plain_groups(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("hub_rows", [linkage.HUB_ROWS, 20])
def test_groups_of_stars_chains_and_random_edges(spark, hub_rows):
    rng = random.Random(2)
    edges = [(5000, 5000 + i) for i in range(1, 400)] + [(7000 + i, 7000) for i in range(1, 300)] + [(7001, 5001)]
    edges += [(i, i + 1) for i in range(1000, 1300)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    nodes = list(range(0, 8000))
    assert groups_of(spark, nodes, edges + edges[:50] + [(3, 3)], hub_rows=hub_rows) == plain_groups(nodes, edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    order = list(range(100_000))
    random.Random(9).shuffle(order)
    rounds = []
    step = linkage._small_star
    monkeypatch.setattr(linkage, "_small_star", lambda *a: rounds.append(1) or step(*a))
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    out = linkage.connected_groups(spark.range(100_000).select(F.col("id").alias("node")), edges)
    assert out.agg(F.max("group"), F.count("*")).first() == (0, 100_000) and len(rounds) <= 17


def test_edges_of_a_hub_are_not_brought_together(spark):
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 900)] + [(i, i - 1) for i in range(1000, 1100)], "_large long, _small long").repartition(6)
    met = linkage._look_up(pairs, "_small", linkage._smallest(pairs), 1000, 100)
    held = met.where("_small = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 6 and met.count() == 999


def test_no_edges(spark):
    assert groups_of(spark, [4, 2], []) == {4: 4, 2: 2}
