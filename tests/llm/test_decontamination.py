import random
import re

import pytest

from harrow.llm import decontamination

from .conftest import document_rows, records

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, window=10):
    """Every window against every place of every document."""
    cut = [(("" if i is None else str(i)), w[s : s + window]) for i, t in items for w in [words(t)] for s in range(max(1, len(w) - window + 1)) if w]
    out = []
    for key, text in docs:
        own, hit, names = words(text), set(), set()
        for name, w in cut:
            for s in range(len(own) - len(w) + 1):
                if own[s : s + len(w)] == w:
                    hit |= set(range(s, s + len(w)))
                    names.add(name)
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((key, len(own), len(hit), sorted(names), spans))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r[0], r["n_words"], r["n_hit"], list(r["items"]), [[s["start"], s["end"]] for s in r["spans"]]) for r in df.collect()), key=repr)


def benchmark_rows():
    texts = [t for _, t, *_ in document_rows() if t]
    part = lambda t, a, b: " ".join(t.split()[a:b])
    rows = [(1, part(texts[0], 20, 37).upper().replace("GÄMMA", "gämma")), (2, part(texts[0], 30, 40)), (2, part(texts[5], 100, 125)), (3, "two -- Words!")]
    return rows + [(4, "one"), (5, ""), (6, None), (None, part(texts[0], 33, 50)), (7, "Kappa kappa"), (8, "never said before by any one here or there at all"), (9, "two words")]


@pytest.mark.parametrize("rows", [decontamination.BROADCAST_ROWS, 0])
def test_hits_are_all_and_only_the_windows(spark, wide, rows):
    items = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    out = decontamination.find_benchmark(wide, items, broadcast_rows=rows)
    expected = brute_force([r[:2] for r in document_rows()], benchmark_rows())
    assert found(out) == expected
    assert sum(e[2] > 0 for e in expected) > 5


def test_random_words_with_many_repeats(spark):
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs = [(i % 30, said(rng.randrange(0, 60))) for i in range(40)]
    items = [(i, said(rng.choice([1, 3, 7, 12, 15]))) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window, shingle in ((10, 5), (4, 2), (6, 6)):
        assert found(decontamination.find_benchmark(df, bench, window=window, shingle=shingle)) == brute_force(docs, items, window)


def test_nothing_to_look_for_or_in(spark, documents, nothing):
    none = spark.createDataFrame([(1, None), (2, " .. ")], "item_id long, text string")
    out = decontamination.find_benchmark(documents, none).collect()
    assert len(out) == len(document_rows()) and all(r["n_hit"] == 0 and r["items"] == [] and r["spans"] == [] for r in out)
    assert decontamination.find_benchmark(nothing, none).collect() == []


def test_clean_rows_stay(spark, wide):
    items = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    kept = decontamination.without_benchmark(wide, items)
    assert kept.columns == wide.columns
    dirty = {(r[0], r[1]) for r, e in ((r, brute_force([r[:2]], benchmark_rows())[0]) for r in document_rows()) if e[2]}
    assert records(kept, "doc_id", "text") == sorted(((r[0], r[1]) for r in document_rows() if (r[0], r[1]) not in dirty), key=repr)


def test_words_of_all_texts_are_found_once(spark, wide, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(df)

    cut_lineage = decontamination.cut_lineage
    monkeypatch.setattr(decontamination, "cut_lineage", noted)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    found = decontamination.find_benchmark(wide, items)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    # texts that are read again are those of a join
    assert sum("regexp_extract_all" in p and "doc_id" in p and "LeftSemi" not in p for p in plans) == 1


def test_query_agrees_with_sql_on_benchmark(spark):
    import duckdb

    from harrow.llm import queries

    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    right = connection.execute(queries.SQL["op11_benchmark_passages"])
    columns = [d[0] for d in right.description]
    found = queries.QUERIES["op11_benchmark_passages"](spark, folder).select(*columns)
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(map(repr, right.fetchall()))
