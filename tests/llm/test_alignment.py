import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrow.llm import alignment

from .conftest import document_rows

FILES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "   ", "a ", " a", "a  b", "  a\n b \t c  ", "\n\n x", "tab\tx \n", "it's  we'll <|endoftext|> <s> </s> <unk> <0x41>", "no▁space", "ﬁ Ａ é é ñ",
    "日本語 テキスト", "😀 👩‍👩‍👧 x", "x" * 3000, " a   b  c", "a\x00b", "\x1c a\x1f b", "12345 67 8.9", "́ a", "end.\n",
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute_force(texts, tokenizers):
    """Token lists by the libraries over whole texts; every pair of tokens looked at."""
    a, b = tokenizers
    entries = {i: alignment.byte_level(t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for text in texts:
        raw = f" {text}".encode()
        own = [(i, entries[i]) for i in a.encode(raw.decode(), add_special_tokens=False).ids] if text else []
        other = [(i, piece(i)) for i in b.encode(text)] if text else []
        if b"".join(t for _, t in own) != raw or b"".join(t for _, t in other) != raw:
            own = other = []
        spans = []
        for tokens in (own, other):
            ends = np.cumsum([len(t) for _, t in tokens]).tolist()
            spans.append(list(zip([i for i, _ in tokens], [0, *ends], ends)))
        common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        for stop in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= stop) for side in spans))
            start = stop
        links = [(i, j) for i, s, e in spans[0] for j, t, u in spans[1] if s < u and t < e]
        counts.update(links)
        docs.append((len(own), len(other), groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (n, m, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), ";".join(g))
        for n, m, g, links in docs
    ]


@pytest.mark.parametrize("n,m", [(0, 0), (1, 0), (0, 3), (1, 1), (5, 9), (9, 5), (700, 9000), (9000, 700), (8000, 8000)])
def test_gallop_ranks_every_value(n, m):
    rng = np.random.default_rng(n + m)
    a, b = (np.sort(rng.choice(20000, k, replace=False)) for k in (n, m))
    rank, met = alignment.gallop(a, b)
    assert rank.tolist() == np.searchsorted(b, a).tolist() and met.tolist() == np.isin(a, b).tolist()


def test_parts_have_the_ids_of_the_whole(tokenizers):
    a, b = tokenizers
    encoders = alignment.Encoders(*(open(f, "rb").read() for f in FILES), PATTERN, remembered=50)
    assert encoders.splits
    rng = random.Random(5)
    pieces = [" ", "  ", "\n", "\t", "a", "The", "é", "'s", "123", "-", " ", "\x1c", "the ", "日", "▁"]
    texts = [t for t in ODD if t] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(800)]
    own, other = encoders.encode(texts)
    kept = 0
    for text, x, y in zip(texts, own, other):
        x, y = np.frombuffer(x, "<u4").tolist(), np.frombuffer(y, "<u4").tolist()
        if x:
            kept += 1
            assert x == a.encode(f" {text}", add_special_tokens=False).ids and y == b.encode(text), repr(text)
        else:
            assert b"".join(encoders.b_tokens[i] for i in b.encode(text)) != f" {text}".encode(), repr(text)
    assert kept > 300


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40])
def test_links_and_counts_equal_brute_force(spark, wide, tokenizers, frequent):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = wide.unionByName(more, allowMissingColumns=True)
    rows = [r[:2] for r in document_rows()] + [(100 + i, t) for i, t in enumerate(ODD)]
    found = alignment.with_link_counts(alignment.align_documents(docs, *FILES, PATTERN), frequent)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = sorted((tuple(r) for r in found.select(columns).collect()), key=repr)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, brute_force([t for _, t in rows], tokenizers))), key=repr)


def test_no_rows(nothing):
    aligned = alignment.align_documents(nothing, *FILES, PATTERN)
    assert alignment.with_link_counts(aligned).collect() == []


def test_query_gives_digests(spark, tmp_path):
    from harrow.llm.queries import QUERIES

    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r.asDict() for r in QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()}
    groups = alignment.align_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), *FILES, PATTERN).where(F.col("doc_id") == 1).first()["groups"]
    assert out[1]["groups_sha256"] == hashlib.sha256(groups.encode()).hexdigest() and out[2]["groups_sha256"] == "" and out[2]["n_links"] == 0
