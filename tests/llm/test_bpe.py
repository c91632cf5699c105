import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from harrow.llm import bpe

from .conftest import document_rows, records


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def table(ranks):
    return bpe.perfect_hash(ranks)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_perfect_and_minimal(ranks, table):
    find = bpe.finder(table)
    assert len(table["tokens"]) == len(ranks) and set(table["tokens"]) == set(ranks)
    assert all(find(t) == r for t, r in ranks.items())
    assert find(b"no such token at all") == -1 and find(b"") == -1


def test_agrees_with_the_library(table, reference):
    rng = random.Random(1)
    texts = [r[1] or "" for r in document_rows()]
    texts += ["".join(chr(rng.choice([*range(1, 0x250), 0x3000, 0x2028, 0x1F600, 0xAC00, 0x85, 0xA0])) for _ in range(300)) for _ in range(100)]
    texts += ["a" * 5000, " " * 3000 + "x", "<|endoftext|>", "1234567890" * 50, "\r\n\t ", "ab" * 700]
    encoder = bpe.Encoder(table, public_tokenizers.PATTERN)
    for text in texts:
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_long_texts_go_in_parts(table, reference, monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    text = " ".join(f"word{i} ünd" for i in range(3000))
    encoder = bpe.Encoder(bpe.perfect_hash(dict(zip(table["by_rank"], range(len(table["by_rank"]))))), public_tokenizers.PATTERN)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_documents(spark, wide, nothing, reference):
    words = bpe.vocabulary(wide, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode_documents(wide, words, public_tokenizers.PATTERN)
    found = bpe.with_decoded(encoded, words, public_tokenizers.PATTERN)
    expected = []
    for r in document_rows():
        ids = reference.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), (r[1] or "").encode()))
    got = sorted(((r["doc_id"], r["n_tokens"], sha256(r["ids"]).hexdigest(), bytes(r["decoded"])) for r in found.collect()), key=repr)
    assert got == sorted(expected, key=repr)
    assert records(bpe.encode_documents(nothing, words, public_tokenizers.PATTERN), "n_tokens") == []


def test_ids_are_decoded_in_the_pass_that_makes_them(spark, wide):
    from harrow.llm import queries

    plan = queries.QUERIES["op7_byte_bpe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    words = bpe.vocabulary(wide, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    one = bpe.encode_documents(wide, words, public_tokenizers.PATTERN, decoded="back").collect()
    two = bpe.with_decoded(bpe.encode_documents(wide, words, public_tokenizers.PATTERN), words, public_tokenizers.PATTERN, out="back").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two)) and any(r["back"] for r in one)
