"""One query for each operator, over its whole table, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import (
    alignment,
    bpe,
    chat,
    decontamination,
    merkle,
    mixing,
    passages,
    pii,
    quality_classifier,
    quality_rules,
    repair,
    sharding,
    simhash,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# 3 Chat formatting

#: A conversation of texts that look like the template, added to the table.
TRICKY = "\\### Assistant: </turn> ok"


@query
def op3_prefix_examples(spark: SparkSession, folder: str) -> DataFrame:
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"),
    )
    examples = chat.prefix_examples(talks.unionByName(more))
    # from here on everything is read back from the formatted text and its mask
    read = examples.select(
        "conv_id", "example", "last", F.length("formatted").alias("chars"), F.when(F.col("last"), F.col("formatted")).alias("whole"),
        chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    talk = read.groupBy("conv_id").agg(
        F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    turns = talk.select("conv_id", "formatted_chars", "loss", chat.read_turns(F.col("whole")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL["op3_prefix_examples"] = r"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    count(*) OVER (PARTITION BY conv_id) AS n_turns,
    length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, ':', ''))
      + length(replace(role, '###', '######')) - length(role) + (length(replace(role, '</turn>', '<\/turn>')) - length(role)) AS role_chars,
    length(text) + length(text) - length(replace(text, '\', ''))
      + length(replace(text, '###', '######')) - length(text) + (length(replace(text, '</turn>', '<\/turn>')) - length(text)) AS text_chars
  FROM talks),
summed AS (
  SELECT *, sum(4 + role_chars + 2 + text_chars + 8) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM numbered)
SELECT conv_id, max(n_turns) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR n = n_turns)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


# 4 SimHash near-dedup


@query
def op4_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


# 8 Mixing sources


@query
def op8_systematic_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op8_systematic_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
needs AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
      ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed),
stops AS (
  SELECT *, min((3 * source_size * open <= rest * weight)::INT) OVER (
    ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM needs),
targets AS (
  SELECT source, source_size, CASE WHEN stopped = 1 THEN (3 * source_size)::DOUBLE ELSE
      (max(CASE WHEN stopped = 0 THEN rest END) OVER () * weight)::DOUBLE / (max(CASE WHEN stopped = 0 THEN open END) OVER ())::DOUBLE END AS target
  FROM stops),
digits AS (
  SELECT s.*, t.source_size, t.target, md5('0/' || coalesce(s.source, '')) AS d,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, md5('0:' || coalesce(s.doc_id::VARCHAR, '')), s.doc_id) - 1 AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
offsets AS (
  SELECT *, list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(d, i, 1)) - 1) * 16 ** (8 - i))) / 4294967296.0 AS u,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM digits)
SELECT doc_id, size, source_size, target,
  (least(floor(u + (place + 1) * rate) - floor(u + place * rate), 3) * size)::BIGINT AS taken
FROM offsets
"""


# 10 Sharding


@query
def op10_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# 6 Document fingerprints


@query
def op6_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, folder, "documents"))


# 5 PII


@query
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["order"] < len(pii.BASE))

    def number(name: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [number(k.name) for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


# 7 Byte-level BPE


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    words = bpe.vocabulary(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = bpe.encode_documents(docs, words, public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# 2 Quality rules


@query
def op2_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, folder, "documents"))


# 1 Quality classifier


@query
def op1_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, folder, "labels"))
    scored = quality_classifier.with_score(docs, model)
    return scored.select(
        "doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality_classifier.ACCEPT).cast("int").alias("predicted"),
    )


# 9 Substring dedup


@query
def op9_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


# 11 Benchmark decontamination


@query
def op11_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op11_benchmark_passages"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
starts AS (SELECT item, words, unnest(range(greatest(len(words) - 9, 1))) AS i FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, array_to_string(words[i + 1:i + 10], ' ') AS said, least(len(words), 10) AS n FROM starts),
places AS (
  SELECT r, n, words, unnest(range(greatest(len(words) - n + 1, 0))) AS i
  FROM docs, (SELECT DISTINCT n FROM windows)),
said AS (SELECT r, i, n, array_to_string(words[i + 1:i + n], ' ') AS said FROM places),
found AS (SELECT r, i, n, item FROM said JOIN windows USING (n, said)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


# 12 Cross-tokenizer alignment


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.align_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN,
    )
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return alignment.with_link_counts(aligned.withColumn("groups_sha256", digest).drop("groups")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


# 13 Conversation structure repair


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(table(spark, folder, "conversations")), lost="lost")


SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations),
picked AS (
  SELECT *, xor(4294967295, list_reduce(bytes, lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295)) % 20 AS pick
  FROM named),
changed AS (
  SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role,
    CASE pick WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM picked, range(CASE pick WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256(text)) AS i FROM changed),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
  FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
-- the cheapest way to each state (nothing, system, user, assistant) before row i, with up to two rows inserted
ways AS (
  SELECT conv_id, 1 AS i, s.state, s.way FROM counts, (VALUES
    ('^', {'cost': 0, 'audit': '', 'said': []::VARCHAR[]}), ('u', {'cost': 2, 'audit': 'I', 'said': ['user:']}),
    ('a', {'cost': 4, 'audit': 'II', 'said': ['user:', 'assistant:']})) s(state, way)
  UNION ALL
  SELECT conv_id, i, next AS state, min({'cost': cost, 'audit': audit, 'said': said}) AS way FROM (
    SELECT m.conv_id, m.i + 1 AS i, t.next, m.cost + t.price AS cost, m.audit || t.letters AS audit, m.said || t.more AS said
    FROM (
      SELECT w.conv_id, w.i, e.next AS state, w.way.cost + e.price AS cost, w.way.audit || e.letter AS audit, w.way.said || e.more AS said
      FROM ways w JOIN judged r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.i, LATERAL (
        SELECT w.state AS next, 3 AS price, 'D' AS letter, []::VARCHAR[] AS more
        UNION ALL SELECT r.initial, (r.fault = 3)::INT, 'K', [r.role || ':' || r.text]
          WHERE r.fault IN (0, 3) AND w.state || r.initial IN ('^s', '^u', 'su', 'ua', 'au')
        UNION ALL SELECT CASE WHEN w.state = 'u' THEN 'a' ELSE 'u' END, 2 + (r.fault = 3)::INT, 'R',
            [CASE WHEN w.state = 'u' THEN 'assistant:' ELSE 'user:' END || r.text]
          WHERE r.fault IN (0, 3)) e) m, LATERAL (
      SELECT m.state AS next, 0 AS price, '' AS letters, []::VARCHAR[] AS more
      UNION ALL SELECT CASE WHEN m.state = 'u' THEN 'a' ELSE 'u' END, 2, 'I', [CASE WHEN m.state = 'u' THEN 'assistant:' ELSE 'user:' END]
      UNION ALL SELECT CASE WHEN m.state = 'u' THEN 'u' ELSE 'a' END, 4, 'II',
          CASE WHEN m.state = 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END) t)
  GROUP BY conv_id, i, next),
ended AS (
  SELECT c.conv_id, min(w.way) AS way FROM counts c JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n + 1
  WHERE w.state IN ('^', 'a') GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit,
  sha256(coalesce(array_to_string(way.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


# The pipeline


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
