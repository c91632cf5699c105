"""Counting, summarising, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import aggregates as agg
from workload.registry import query


@query(
    "AG-01",
    """
    WITH e AS (SELECT nullif(event_type, 'view') AS event_type, user_id % 3 AS g FROM events)
    SELECT event_type, g, count(*) AS n, count(*) / (SELECT count(*) FROM e) AS share FROM e GROUP BY 1, 2
    """,
)
def frequency_table(t):
    e = t.events.select(F.nullif(F.col("event_type"), F.lit("view")).alias("event_type"), (F.col("user_id") % 3).alias("g"))
    return agg.frequency(e, ["event_type", "g"], share="share")


@query(
    "AG-02 AG-14",
    """
    SELECT event_type, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high,
      min(ts)::DATE AS first_date, max(ts)::DATE AS last_date FROM events GROUP BY 1
    """,
    days="first_date last_date",
)
def named_aggregates(t):
    return t.events.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"),
        F.round(F.sum("value"), 4).alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min("ts").cast("date").alias("first_date"),
        F.max("ts").cast("date").alias("last_date"),
    )


@query(
    "AG-03 PL-11",
    """
    SELECT p_brand, round(avg(m), 6) AS mean_measure, round(sum(m), 2) AS sum_measure, count(m) AS count_measure, round(sum(l_quantity), 2) AS sum_unit,
      round(sum(m) / sum(l_quantity), 6) AS per_unit
    FROM (SELECT nullif(p_brand, 'Brand#3') AS p_brand, CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS m, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)
    WHERE p_brand IS NOT NULL GROUP BY 1
    """,
)
def ratio_per_unit(t):
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.nullif(F.col("p_brand"), F.lit("Brand#3")).alias("p_brand"),
        F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("m"),
        "l_quantity",
    )
    out = agg.ratio_per_unit(df, ["p_brand"], "m", "l_quantity")
    digits = {"mean_measure": 6, "sum_measure": 2, "sum_unit": 2, "per_unit": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "AG-04",
    "SELECT l_suppkey, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_extendedprice), 6) AS mean_l_extendedprice FROM lineitem GROUP BY 1",
)
def sums_and_means(t):
    out = agg.sums_and_means(t.lineitem, ["l_suppkey"], ["l_quantity"], ["l_extendedprice"])
    return out.withColumns(
        {"sum_l_quantity": F.round("sum_l_quantity", 2), "mean_l_extendedprice": F.round("mean_l_extendedprice", 6)}
    )


@query(
    "AG-05 PL-08 DT-03",
    """
    SELECT year(o_orderdate)::INTEGER AS year, count(DISTINCT o_custkey) AS unique_employers,
      count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS with_finding,
      count(DISTINCT CASE WHEN o_totalprice > 400000 THEN o_custkey END) AS with_violation, count(DISTINCT o_orderkey) AS unique_jobs
    FROM orders GROUP BY 1
    """,
)
def distinct_counts_by_year(t):
    return agg.distinct_counts(
        t.orders.withColumn("year", F.year("o_orderdate")), ["year"], "o_custkey",
        {"unique_employers": None, "with_finding": F.col("o_orderstatus") == "F", "with_violation": F.col("o_totalprice") > 400000},
    ).join(agg.distinct_counts(t.orders.withColumn("year", F.year("o_orderdate")), ["year"], "o_orderkey", {"unique_jobs": None}), "year")


@query(
    "AG-06",
    """
    SELECT year(o_orderdate)::INTEGER AS year, count(DISTINCT o_custkey) AS unique_units,
      count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) / count(DISTINCT o_custkey) AS urgent,
      count(DISTINCT CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey END) / count(DISTINCT o_custkey) AS low
    FROM orders GROUP BY 1
    """,
)
def distinct_proportions(t):
    df = t.orders.withColumn("year", F.year("o_orderdate"))
    return agg.distinct_proportions(df, ["year"], "o_custkey", "o_orderpriority", {"urgent": "1-URGENT", "low": "5-LOW"})


@query(
    "AG-07",
    """
    SELECT p_brand, round(median(p_retailprice), 6) AS median_price, round(avg((p_size > 25)::DOUBLE), 6) AS share_big FROM part GROUP BY 1
    """,
)
def median_and_share(t):
    median = agg.medians(t.part, ["p_brand"], "p_retailprice", "median_price")
    share = t.part.groupBy("p_brand").agg(F.round(agg.share_true(F.col("p_size") > 25), 6).alias("share_big"))
    return median.withColumn("median_price", F.round("median_price", 6)).join(share, "p_brand")


@query(
    "AG-08",
    """
    WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL),
    b AS (SELECT p_brand, max(n) AS m FROM c GROUP BY 1)
    SELECT c.p_brand, p_size AS tied_mode, min(p_size) OVER (PARTITION BY c.p_brand) AS mode FROM c JOIN b ON c.p_brand = b.p_brand AND n = m
    """,
)
def modes_by_group(t):
    one = agg.modes(t.part, ["p_brand"], "p_size", "mode")
    return agg.all_modes(t.part, ["p_brand"], "p_size", "tied_mode").join(one, "p_brand")


@query(
    "AG-09",
    """
    WITH seg AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
    st AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o.o_custkey, round(avg(o_totalprice), 6) AS o_totalprice, min(o_orderdate)::DATE AS START_DATE, max(o_orderdate)::DATE AS END_DATE,
      (SELECT o_orderpriority FROM seg WHERE seg.o_custkey = o.o_custkey ORDER BY n DESC, o_orderpriority LIMIT 1) AS o_orderpriority,
      (SELECT o_orderstatus FROM st WHERE st.o_custkey = o.o_custkey ORDER BY n DESC, o_orderstatus LIMIT 1) AS o_orderstatus
    FROM orders o GROUP BY o.o_custkey
    """,
    days="START_DATE END_DATE",
)
def representative_rows(t):
    day = F.col("o_orderdate").cast("date")
    df = t.orders.select(
        "o_custkey", "o_totalprice", day.alias("START_DATE"), day.alias("END_DATE"), "o_orderpriority", "o_orderstatus"
    )
    out = agg.representative_rows(df, "o_custkey")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query(
    "AG-10",
    """
    SELECT conv_id, 0::BIGINT AS part, string_agg(replace(text, chr(10), ''), ' || ' ORDER BY turn) AS text,
      length(string_agg(replace(text, chr(10), ''), ' || ' ORDER BY turn))::INTEGER AS n_chars
    FROM conversations GROUP BY 1
    """,
)
def concatenated_sections(t):
    return agg.concat_text(t.conversations, "conv_id", "text", ["turn"])


@query(
    "AG-11",
    "SELECT o_orderkey, o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) AS is_high FROM orders",
)
def above_quantile(t):
    return agg.flag_at_quantile(t.orders, "o_totalprice", 0.95).select("o_orderkey", "is_high")


@query(
    "AG-12",
    """
    WITH s AS (
      SELECT 'o_totalprice' AS variable, count(o_totalprice)::DOUBLE AS "count", avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min,
        quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75, max(o_totalprice) AS max FROM orders
      UNION ALL
      SELECT 'o_custkey', count(o_custkey)::DOUBLE, avg(o_custkey), stddev_samp(o_custkey), min(o_custkey), quantile_cont(o_custkey::DOUBLE, 0.25),
        quantile_cont(o_custkey::DOUBLE, 0.5), quantile_cont(o_custkey::DOUBLE, 0.75), max(o_custkey) FROM orders)
    SELECT variable, statistic, round(value, 4) AS value FROM s UNPIVOT (value FOR statistic IN ("count", mean, std, min, p25, p50, p75, max))
    UNION ALL SELECT 'o_orderpriority', 'count', count(o_orderpriority)::DOUBLE FROM orders
    UNION ALL SELECT 'o_orderpriority', 'unique', count(DISTINCT o_orderpriority)::DOUBLE FROM orders
    """,
)
def described_columns(t):
    out = agg.describe(t.orders, ["o_totalprice", "o_custkey"], ["o_orderpriority"])
    return out.withColumn("value", F.round("value", 4))


@query(
    "AG-13",
    """
    WITH v AS (SELECT event_id, nullif(event_type, 'view') AS event_type, CASE WHEN value > 5 THEN value END AS value FROM events)
    SELECT 'event_id' AS variable, count(*) FILTER (event_id IS NULL) AS nulls FROM v
    UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL) FROM v
    UNION ALL SELECT 'value', count(*) FILTER (value IS NULL) FROM v
    """,
)
def null_counts(t):
    v = t.events.select(
        "event_id", F.nullif(F.col("event_type"), F.lit("view")).alias("event_type"), F.when(F.col("value") > 5, F.col("value")).alias("value")
    )
    return agg.null_counts(v)


@query(
    "AG-14",
    "SELECT l_suppkey, min(l_shipdate)::DATE AS first_date, max(l_shipdate)::DATE AS last_date FROM lineitem GROUP BY 1",
    days="first_date last_date",
)
def date_ranges(t):
    return agg.date_range(t.lineitem.withColumn("d", F.col("l_shipdate").cast("date")), "d", ["l_suppkey"])


@query(
    "AG-15",
    """
    SELECT count(*) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS n_rows_with, count(DISTINCT l_orderkey) AS n_units,
      count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS n_units_with,
      count(*) FILTER (l_returnflag = 'R') / count(*) AS share_rows_with,
      count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') / count(DISTINCT l_orderkey) AS share_units_with
    FROM lineitem
    """,
)
def subset_shares(t):
    return agg.subset_shares(t.lineitem, F.col("l_returnflag") == "R", "l_orderkey")


@query(
    "AG-16",
    """
    SELECT l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N,
      round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY 1
    """,
)
def long_to_wide(t):
    wide = agg.widen(t.lineitem, ["l_suppkey"], "l_returnflag", "l_quantity", ["A", "N", "R"])
    return wide.withColumns({c: F.round(c, 6) for c in "ANR"})


@query(
    "AG-17",
    """
    SELECT o_orderkey, variable, value FROM (SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS o_custkey FROM orders)
    UNPIVOT (value FOR variable IN (o_totalprice, o_custkey))
    """,
)
def wide_to_long(t):
    df = t.orders.select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return agg.lengthen(df, ["o_orderkey"], ["o_totalprice", "o_custkey"])


@query(
    "AG-18 ML-09",
    """
    WITH v AS (SELECT event_type AS model, value > 10 AS p, user_id % 10 = 0 AND event_type <> 'view' AS a FROM events)
    SELECT m.model, x.a AS actual, y.p AS predicted, (SELECT count(*) FROM v WHERE v.model = m.model AND v.a = x.a AND v.p = y.p) AS n
    FROM (SELECT DISTINCT model FROM v) m, (VALUES (true), (false)) x(a), (VALUES (true), (false)) y(p)
    """,
)
def confusion_counts(t):
    df = t.events.select(
        F.col("event_type").alias("model"), (F.col("value") > 10).alias("predicted"),
        ((F.col("user_id") % 10 == 0) & (F.col("event_type") != "view")).alias("actual"),
    )
    return agg.cross_counts(df, "actual", "predicted", ["model"])


@query(
    "AG-19 PL-12",
    """
    SELECT l_orderkey AS category, count(*) FILTER (l_returnflag = 'R') AS positives, count(*) FILTER (l_returnflag <> 'R') AS negatives,
      count(*) FILTER (l_returnflag = 'R') / count(*) * 100 AS percent_positive
    FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag <> 'R') > 0
    """,
)
def percent_positive(t):
    df = t.lineitem.withColumnRenamed("l_orderkey", "category")
    return agg.percent_positive(df, "category", F.col("l_returnflag") == "R")


@query(
    "AG-20 STR-10 NUM-01",
    """
    WITH s AS (SELECT l_suppkey, l_returnflag, l_linestatus || l_linenumber::VARCHAR AS suffix, sum(CASE WHEN l_suppkey % 9 = 0 AND l_linenumber = 1 THEN 0 ELSE l_quantity END) AS v
      FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, suffix, v, CASE WHEN f <> 0 THEN v / f END AS ratio FROM (
      SELECT *, first_value(v) OVER w AS f, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY l_suppkey, l_returnflag ORDER BY suffix)) WHERE n > 1
    """,
)
def ratio_to_universe(t):
    amount = F.when((F.col("l_suppkey") % 9 == 0) & (F.col("l_linenumber") == 1), F.lit(0.0)).otherwise(F.col("l_quantity"))
    suffix = F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("suffix")
    sums = t.lineitem.groupBy("l_suppkey", "l_returnflag", suffix).agg(F.sum(amount).alias("v"))
    # quantities are whole numbers, so sums and ratios are the same to the last bit
    return agg.ratio_to_first(sums, ["l_suppkey", "l_returnflag"], "suffix", "v")


@query(
    "AG-21",
    """
    WITH v AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 350000 THEN o_orderpriority END AS party, CASE WHEN o_totalprice < 200000 THEN o_orderstatus END AS state FROM orders)
    SELECT *, bool_and(party IS NULL) OVER (PARTITION BY o_custkey) AS all_party_missing, bool_and(state IS NULL) OVER (PARTITION BY o_custkey) AS all_state_missing FROM v
    """,
)
def all_missing_flags(t):
    v = t.orders.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_totalprice") > 350000, F.col("o_orderpriority")).alias("party"),
        F.when(F.col("o_totalprice") < 200000, F.col("o_orderstatus")).alias("state"),
    )
    return agg.all_missing_flags(v, "o_custkey", ["party", "state"])


@query(
    "AG-22",
    """
    SELECT o_custkey, o_orderpriority, o_orderkey FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1
    """,
)
def first_of_duplicates(t):
    return agg.first_of_duplicates(
        t.orders, ["o_custkey", "o_orderpriority"], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    ).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("AG-22", "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)")
def repeated_texts(t):
    return agg.all_duplicates(t.documents, ["text"]).select("doc_id")


@query("AG-22", "SELECT DISTINCT lang, source, text FROM documents")
def distinct_rows(t):
    return t.documents.select("lang", "source", "text").dropDuplicates()


@query(
    "AG-23",
    """
    SELECT l_suppkey, round(avg(v) FILTER (NOT isnan(v)), 6) AS mean_v FROM (
      SELECT DISTINCT l_suppkey, l_partkey, CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE l_tax END AS v FROM lineitem) GROUP BY 1
    """,
)
def mean_of_distinct(t):
    v = t.lineitem.select(
        "l_suppkey", "l_partkey", F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("v")
    )
    out = agg.mean_of_distinct(v, ["l_suppkey"], "v", ["l_partkey"])
    return out.withColumn("mean_v", F.round("mean_v", 6))


@query(
    "AG-24",
    """
    WITH c AS (SELECT event_type, user_id % 4 AS cell, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, cell, n, n / (SELECT max(s) FROM (SELECT sum(n) AS s FROM c GROUP BY event_type)) * 100 AS percent FROM c
    """,
)
def class_percents(t):
    return agg.class_percents(t.events.withColumn("cell", F.col("user_id") % 4), ["event_type", "cell"])


@query(
    "AG-25 W-02",
    """
    WITH top AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 5)
    SELECT doc_id, source, source IN (SELECT * FROM top) AS is_top_category,
      source IN (SELECT * FROM top) AND doc_id = min(doc_id) OVER (PARTITION BY source) AS is_example FROM documents
    """,
)
def top_category_examples(t):
    docs = t.documents.select("doc_id", "source")
    marked, examples = agg.top_category_examples(docs, "source", [F.col("doc_id").asc()], 5)
    shown = examples.select("doc_id", F.lit(True).alias("_example"))
    return marked.join(shown, "doc_id", "left").select(
        "doc_id", "source", "is_top_category", F.coalesce("_example", F.lit(False)).alias("is_example")
    )
