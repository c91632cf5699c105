import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from harrow.llm import bpe, queries

from .conftest import NAMES, document_rows

FOLDER = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES) and set(queries.SQL) <= set(entry.oracle_sql())
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, FOLDER).cache()
        assert out.columns == docs.columns, name
        assert out.schema.simpleString() == docs.schema.simpleString()
        kept = out
    assert 0 < kept.select("doc_id").distinct().count() < docs.count()
    assert kept.where(F.col("text").contains("@mail")).count() == 0
    last = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        last.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    expected = {}
    for r in kept.collect():
        expected.setdefault(r["doc_id"], []).append(reference.encode_ordinary(r["text"]))
    assert last == expected


@pytest.mark.parametrize("rows", [document_rows(), []])
def test_messy_and_empty_tables(spark, tmp_path, rows):
    extra = spark.createDataFrame([(*r, 1, "x") for r in rows], NAMES + ", score long, ids string")
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == bool(rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for t in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    right = connection.execute(queries.SQL[name])
    columns = [d[0] for d in right.description]
    found = queries.QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == sorted(map(repr, right.fetchall()))
