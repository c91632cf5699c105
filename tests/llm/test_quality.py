import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import measures, quality_classifier, quality_rules

from .conftest import document_rows


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered, seen, lines = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered)


def test_measures_by_brute_force():
    odd = ["a b c a b c", "x x x x", "l\nl\n \n \nl\r", "a\x0bb\x85c\xa0d", "#*$%&|<>", "\x1c a  "]
    for text in [*odd, *[r[1] for r in document_rows()]]:
        m = measures.measure(text)
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute_measures(text)
        assert measures.class_counts(text or "").sum() == len(text or "")


def test_divergence():
    p, q = np.array([1.0, 0, 3]), np.array([0.0, 2, 0])
    assert quality_rules.jensen_shannon(p, p) == 0 and quality_rules.jensen_shannon(p, q) == pytest.approx(1)
    assert 0 < quality_rules.jensen_shannon(p, np.array([1.0, 1, 1])) < 1


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(2)
    words = {"en": ["the", "of", "and", "cat", "house", "tree", "sees"], "de": ["der", "und", "Haus", "Baum", "sieht", "eine"]}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(words[lang]) + str(rng.randrange(9)) * (rng.random() < 0.5) for _ in range(100)), lang))
    rows += [(200, " ".join("THE!! OF## $$AND".split()[rng.randrange(3)] + str(rng.randrange(500)) for _ in range(100)), "en"), (201, rows[0][1], "en"), (202, rows[0][1], None), (203, None, "en"), (204, "short", "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_references_hold_all_documents(prose, monkeypatch):
    rows = [r for r in prose.collect() if r["lang"] and len((r["text"] or "").split()) >= 50]
    for counted in (150, 1 << 20):
        monkeypatch.setattr(quality_rules, "COUNTED", counted)
        found = quality_rules.references(prose, common=0.02)
        assert set(found) == {"en", "de"}
        for lang, own in found.items():
            words = Counter(w.encode() for r in rows if r["lang"] == lang for w in r["text"].split())
            assert own["words"] == {w: n for w, n in words.items() if n >= 0.02 * words.total()}
            assert own["rest"] == words.total() - sum(own["words"].values())
            assert own["classes"].tolist() == sum(measures.class_counts(r["text"]) for r in rows if r["lang"] == lang).tolist()


def test_verdicts(prose):
    rows = {r["doc_id"]: r for r in quality_rules.judge_documents(prose, word_limit=0.7).collect()}
    assert all(rows[i]["kept"] for i in range(120))
    assert not rows[200]["kept"] and not rows[200]["base_failed"]  # foreign classes
    assert not rows[201]["kept"]  # German under an English label
    assert rows[202]["kept"]  # without a label the nearest language counts
    assert rows[203]["base_failed"] and rows[204]["base_failed"] and rows[204]["char_distance"] is None


def test_rules_on_messy_rows(wide, nothing):
    rows = quality_rules.judge_documents(wide).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows))) == sorted(
        repr((r[0], *brute_measures(r[1]))) for r in document_rows()
    )
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)
    assert quality_rules.judge_documents(nothing).collect() == []


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90)))
    bad = lambda: " ".join([rng.choice(["BUY!!", "$$$", "##"])] * rng.randrange(20, 90))
    rows = [(i, good() if i % 4 else bad()) for i in range(800)]
    labels = [(i, int(i % 4 > 0)) for i in range(0, 800, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(graded):
    docs, labels = graded
    model = quality_classifier.fit(docs, labels)
    assert 0.5 < model.prior < 0.95
    rows = quality_classifier.with_score(docs, model).select("*", quality_classifier.held_out(F.col("doc_id")).alias("out")).collect()
    for r in rows:
        assert r["out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and (r["score"] >= 0.3) == (r["doc_id"] % 4 > 0)
    kept = quality_classifier.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0").count() == 0 and kept.count() == 600


def test_only_learning_folds_and_positives_count(graded):
    docs, labels = graded
    # held-out labels turned over and labels 0 left out change nothing
    other = labels.where((F.col("quality") == 1) | quality_classifier.held_out(F.col("doc_id"))).withColumn(
        "quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = quality_classifier.fit(docs, labels), quality_classifier.fit(docs, other)
    assert a.prior == b.prior and all((x == y).all() for x, y in zip(a.weights, b.weights))


def test_prior_from_scores():
    rng = np.random.default_rng(0)
    positive, unlabelled = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2400), rng.normal(-2, 1, 5600)])
    assert quality_classifier.estimated_prior(positive, unlabelled) == pytest.approx(0.3, abs=0.06)


def test_scores_of_messy_rows(wide, nothing, spark, graded):
    model = quality_classifier.fit(*graded)
    rows = quality_classifier.with_score(wide, model)
    assert rows.count() == len(document_rows()) and rows.where("score between 0 and 1").count() == len(document_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.accepted(wide, none).count() == len(document_rows())  # nothing to learn from
    assert quality_classifier.accepted(nothing, none).collect() == []
    twice = graded[1].union(graded[1]).union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int"))
    assert quality_classifier.fit(graded[0], twice).prior == model.prior
