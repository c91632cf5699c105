from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from harrow.llm import chat, queries

TALKS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi\n"), (1, 2, "assistant", "### Assistant: </turn>\n ok \\"), (1, 3, "user", ""), (1, 4, "assistant", "é####"),
    (2, 0, "user", "no reply"), (3, 0, "assistant", None), (3, 1, None, "odd: role"), (4, 5, "user", "tie"), (4, 5, "assistant", "tie"),
    (None, None, "assistant", "no id"), (5, 1, "a: b### </turn>\\", "x"), (5, None, "user", "first"), (6, 0, "user", "again"), (6, 0, "user", "again"),
    (7, 0, "assistant", "\\#\\/turn> <\\/turn> \\\\"),
]


def turns(n=200):
    long = [(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " + "word " * 50) for i in range(n)]
    return TALKS + long


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(*r, "extra", 1, 2) for r in turns()]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, conv int, said int")


def expected():
    out = {}
    for r in sorted(turns(), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def test_examples_read_back(talks):
    examples = chat.prefix_examples(talks).select(
        "*", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"), chat.read_turns(F.col("formatted")).alias("read")
    ).collect()
    by = {}
    for e in sorted(examples, key=lambda e: e["example"]):
        by.setdefault(e["conv_id"], []).append(e)
    assert by.keys() == expected().keys()
    for conv, said in expected().items():
        found = by[conv]
        assert [e["loss"] for e in found if e["loss_end"] > e["loss_start"]] == [t for r, t in said if r == "assistant" and t]
        assert [tuple(x) for x in found[-1]["read"]] == said
        assert [e["last"] for e in found] == [False] * (len(found) - 1) + [True]
        replies = [i + 1 for i, (r, _) in enumerate(said) if r == "assistant"]
        assert [len(e["read"]) for e in found] == sorted({*replies, len(said)})
        for e in found:
            assert e["formatted"].count("</turn>") == len(e["read"])


def test_rest_can_be_left_out(talks):
    kept = chat.prefix_examples(talks, keep_rest=False).where("conv_id in (2, 6)")
    assert kept.count() == 0


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.prefix_examples(none).collect() == []


def test_query_agrees_with_sql_on_odd_texts(spark, tmp_path):
    spark.createDataFrame(turns(20), "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op3_prefix_examples(spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    right = connection.execute(queries.SQL["op3_prefix_examples"])
    names = [d[0] for d in right.description]
    assert sorted(map(repr, right.fetchall())) == sorted(repr(tuple(r)) for r in found.select(*names).collect())
    tricky = next(r for r in found.collect() if r["conv_id"] == -7)
    assert tricky["loss_sha256"] == sha256(queries.TRICKY.encode()).hexdigest() and tricky["n_turns"] == 2
