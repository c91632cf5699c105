from hashlib import sha256

import pytest

from harrow.llm import merkle

from .conftest import document_rows


def test_roots_tell_equality():
    texts = {r[1] or "" for r in document_rows()} | {"a\nb", "a\n\nb", "a\n \nb", "ab", "a\nb\n", "\n", "\n\n"}
    assert len({merkle.fingerprint(t)[: merkle.NODE] for t in texts}) == len(texts)
    assert merkle.fingerprint(None) == merkle.fingerprint("")


def test_branches_locate_edits():
    text = "first line\nsecond line of it\n\nthird line here\nfourth line"
    changed = text.replace("third", "another")
    left, right = merkle.fingerprint(text), merkle.fingerprint(changed)
    assert merkle.differing_paragraphs(left, right) == [(1, 0)] and merkle.differing_paragraphs(left, left) == []
    assert 0 < merkle.likeness(left, right) < 1 and merkle.likeness(left, left) == 1
    assert merkle.likeness(left, right) == merkle.likeness(right, left)


def test_likeness_follows_what_is_shared():
    words = [f"w{i}q{i * 7 % 13}" for i in range(2000)]
    whole = " ".join(words)
    half = " ".join(words[:1000] + [f"other{i}" for i in range(1000)])
    none = " ".join(f"zz{i}" for i in range(2000))
    mark = merkle.fingerprint(whole)
    assert 0.4 < merkle.likeness(mark, merkle.fingerprint(half)) < 0.6
    assert merkle.likeness(mark, merkle.fingerprint(none)) < 0.01


@pytest.mark.parametrize("chars", [50, 700, 1 << 24])
def test_next_documents(documents, wide, chars):
    docs = sorted(document_rows(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = {}
    for r in docs:
        texts.setdefault(r[0], set()).add(r[1] or "")
    rows = merkle.compare_with_next(wide, chars_per_slice=chars).collect()
    assert len(rows) == len(docs)
    ids = [r[0] for r in docs]
    for r in rows:
        # rows of one id follow each other in some fixed order; the last of them meets the next id
        i = max(j for j, x in enumerate(ids) if x == r["doc_id"])
        following = texts[ids[(i + 1) % len(ids)]] | texts[r["doc_id"]]
        own = [t for t in texts[r["doc_id"]] if merkle.fingerprint(t) == r["fingerprint"]]
        assert len(own) == 1 and r["n_chars"] == len(own[0])
        match = [n for n in following if sha256(merkle.edited(own[0], n).encode()).hexdigest() == r["edited_sha256"]
                 and merkle.likeness(r["fingerprint"], merkle.fingerprint(n)) == r["near_next"]]
        assert match and r["edited_fingerprint"] == merkle.fingerprint(merkle.edited(own[0], match[0]))
        assert r["near_edited"] == merkle.likeness(r["fingerprint"], r["edited_fingerprint"])
    single = {r["doc_id"]: r for r in rows if ids.count(r["doc_id"]) == 1}
    for i, x in enumerate(ids):
        y = ids[(i + 1) % len(ids)]
        if x in single and ids.count(y) == 1:
            text, = texts[x]
            other, = texts[y]
            assert single[x]["edited_sha256"] == sha256(merkle.edited(text, other).encode()).hexdigest()


def test_one_row_and_none(spark, nothing):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    row = merkle.compare_with_next(one).first()
    assert row["edited_sha256"] == sha256(b"abab").hexdigest() and row["near_next"] == 1
    assert merkle.compare_with_next(nothing).collect() == []
