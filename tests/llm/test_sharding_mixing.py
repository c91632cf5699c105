import random
from collections import Counter, defaultdict
from hashlib import md5, sha256
from itertools import combinations
from math import floor
import re
import zlib

import pytest
from pyspark.sql import functions as F

from harrow.llm import mixing, sharding

from .conftest import document_rows, records


def least_capacity(sizes, shards):
    """The smallest greatest shard, by halving between capacities that fail and that do."""
    def count(capacity):
        used, held = 1, 0
        for s in sizes:
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
        return used

    low, high = max(sizes) - 1, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if count(middle) <= shards else (middle, high)
    return high


def two_valued(n):
    rng = random.Random(n)
    return [rng.choice([16, 5000]) for _ in range(n)]


@pytest.mark.parametrize(
    "sizes,shards,cells",
    [
        ([random.Random(i).choice([1, 2, 17, 300]) for i in range(90)], 1, 4),
        ([random.Random(i).choice([1, 2, 17, 300]) for i in range(90)], 3, 2),
        ([random.Random(i).choice([1, 2, 17, 300]) for i in range(90)], 7, 3),
        (two_valued(200), 40, 512),
        (two_valued(3000), 100, 2),
        ([int(random.Random(i).lognormvariate(7, 1.5)) + 16 for i in range(20_000)], 64, 2),
        ([5, 9, 2], 40, 512),
        ([7], 5, 2),
        ([10**12 * (i % 7 + 1) for i in range(300)], 40, 2),
        (two_valued(1500), 1000, 2),
    ],
)
def test_cuts_have_the_least_capacity(spark, sizes, shards, cells):
    sums, total = [], 0
    for s in sizes:
        total += s
        sums.append(total)
    cuts = sharding.smallest_capacity_cuts(spark.createDataFrame([(x,) for x in sums], "upto long"), shards, cells)
    ends = [0, *cuts, total]
    assert len(cuts) == shards - 1 and set(cuts) <= {0, *sums} and ends == sorted(ends)
    assert max(b - a for a, b in zip(ends, ends[1:])) == least_capacity(sizes, shards)


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_every_row_has_a_place(documents, wide, shards):
    rows = sharding.shard_documents(wide, shards=shards, rows_per_part=5).collect()
    texts = Counter((r[0], r[1]) for r in document_rows())
    assert len(rows) == sum(texts.values())
    slots, group = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < shards
        group[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in group.values())
    known = Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in document_rows())
    assert known == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    again = sharding.shard_documents(documents, shards=shards, rows_per_part=5)
    assert records(again, *again.columns) == sorted((tuple(r) for r in rows), key=repr)


def test_group_above_a_share_stands_alone(spark):
    docs = spark.createDataFrame([(i, "hot" * 50) for i in range(60)] + [(100 + i, "x" * (i % 9)) for i in range(90)], "doc_id long, text string")
    shards = sharding.shard_documents(docs, shards=5, rows_per_part=7).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    sizes = {r["shard"]: (r["n"], r["b"]) for r in shards}
    assert sizes[4] == (60, 60 * 166)
    rest = [sizes[i][1] for i in range(4)]
    # the nine other groups in the order of their hashes: no cut of them into four has a smaller largest shard
    texts = sorted({"x" * i for i in range(9)}, key=lambda t: sha256(t.encode()).hexdigest())
    weights = [10 * (16 + len(t)) for t in texts]
    best = min(max(sum(weights[a:b]) for a, b in zip((0, *c), (*c, 9))) for c in combinations(range(1, 9), 3))
    assert sum(rest) == sum(weights) and max(rest) == best


def test_no_rows(nothing):
    assert sharding.shard_documents(nothing).collect() == []
    assert mixing.mix(nothing).collect() == [] and mixing.mixed_documents(nothing).collect() == []


def targets(sizes, limit=3):
    """Shares by weight; what stands above the limit is shared again until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > limit * sizes[s]}
        if not above:
            return out | share
        out |= {s: float(limit * sizes[s]) for s in above}
        left -= sum(limit * sizes[s] for s in above)
        open_ -= above
    return out


def test_mix_is_systematic(documents, wide):
    rows = document_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for _, t, _, s, _ in rows:
        per[s] += size(t)
    goal = targets(per)
    expected = []
    for s in per:
        own = sorted((-size(t), md5(f"0:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0) for i, t, _, x, _ in rows if x == s)
        u, rate = int(md5(f"0/{s or ''}".encode()).hexdigest()[:8], 16) / 2**32, goal[s] / per[s] if per[s] else 0
        for k, (z, _, known, i) in enumerate(own):
            copies = min(3, floor(u + (k + 1) * rate) - floor(u + k * rate))
            expected.append((i if known else None, -z, per[s], copies, copies * -z))
    found = mixing.mix(wide, rows_per_part=3)
    assert records(found, "doc_id", "size", "source_size", "copies", "taken") == sorted(expected, key=repr)
    got = {r["source"]: r["target"] for r in found.collect()}
    assert got == pytest.approx(goal)
    assert [c for c in found.columns if c.lower() == "copies"] == ["copies"] and "fp" in found.columns


def test_targets_stop_and_share_again(spark):
    sizes = {"a": 1000, "b": 1, "c": 2, "d": 0, "é": 50, None: 7}
    found = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in found} == pytest.approx(targets(sizes))


def test_mixture_keeps_the_columns(wide):
    copies = mixing.mix(wide, prefix="__x_").groupBy().agg(F.sum("__x_copies")).first()[0]
    out = mixing.mixed_documents(wide)
    assert out.columns == wide.columns and out.count() == copies
