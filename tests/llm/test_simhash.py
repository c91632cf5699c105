import random

import xxhash
from pyspark.sql import functions as F

from harrow.llm import simhash

from .conftest import document_rows, records


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest index reachable over links of at most two bits."""
    group = list(range(len(prints)))
    moved = True
    while moved:
        moved = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    moved = True
    return group


def test_fingerprint_is_that_of_the_definition():
    for _, text, *_ in document_rows():
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_words_are_ascii_separated():
    assert simhash.fingerprint("A\x0bB c D  e") == brute_fingerprint("a b c d e")


def test_components_by_brute_force(documents, wide):
    rows = sorted(document_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute_fingerprint(r[1]) for r in rows]
    group = brute_components(prints)
    expected = sorted(((r[0], f"{p:016x}", rows[g][0]) for r, p, g in zip(rows, prints, group)), key=repr)
    found = simhash.near_duplicates(wide)
    assert records(found, "doc_id", "fingerprint", "component_id") == expected


def test_links_of_crowded_blocks(spark):
    """Many fingerprints about one centre: blocks above the limit go by variants and lose no link."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(40)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    mask = (1 << 64) - 1
    group = brute_components([p & mask for p in prints])
    for largest in (2, 20, 1000):
        links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(table, largest=largest).collect()]
        place = {p: i for i, p in enumerate(prints)}
        own = list(range(len(prints)))
        moved = True
        while moved:
            moved = False
            for a, b in links:
                i, j = place[a], place[b]
                if own[i] != own[j]:
                    own[i] = own[j] = min(own[i], own[j])
                    moved = True
        assert own == group


def test_one_row_of_each_group_stays(wide):
    kept = simhash.one_of_each_group(wide)
    assert kept.columns == wide.columns
    found = simhash.near_duplicates(wide)
    groups = found.select("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint"))).distinct().count()
    assert kept.count() == groups
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 11 not in ids and 4 in ids and 5 not in ids


def test_no_rows(nothing):
    assert simhash.near_duplicates(nothing).collect() == [] and simhash.one_of_each_group(nothing).collect() == []
