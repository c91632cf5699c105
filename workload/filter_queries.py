"""Row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import filters
from workload.registry import query


@query(
    "FLT-01 SRC-01",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT','2-HIGH') AND o_totalprice > 100000
    """,
)
def equality_in_comparison(t):
    return t.orders.where(
        (F.col("o_orderstatus") == "F")
        & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & (F.col("o_totalprice") > 100000)
    ).select("o_orderkey", "o_totalprice")


@query(
    "FLT-02",
    """
    SELECT p_partkey, p_brand FROM part
    WHERE regexp_matches(p_brand, '^Brand#1') OR p_brand IN (SELECT 'Brand#' || s_nationkey::VARCHAR FROM supplier WHERE s_acctbal > 9000)
    """,
)
def pattern_or_listed_code(t):
    listed = t.supplier.where("s_acctbal > 9000").select(
        F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("code")
    )
    return filters.pattern_or_member(t.part, "p_brand", "^Brand#1", listed, "code").select("p_partkey", "p_brand")


@query(
    "FLT-02 JN-07",
    """
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS has_large FROM customer
    """,
)
def membership_flags(t):
    large = t.orders.where("o_totalprice > 400000")
    return filters.member_flag(t.customer, F.col("c_custkey"), large, "o_custkey", "has_large").select(
        "c_custkey", "has_large"
    )


@query(
    "FLT-03",
    """
    WITH v AS (SELECT event_id, CASE WHEN value > 5 THEN value END AS a, nullif(event_type, 'view') AS b FROM events)
    SELECT event_id, a, b, a IS NOT NULL AND b IS NOT NULL AS complete FROM v
    """,
)
def complete_and_incomplete(t):
    v = t.events.select(
        "event_id",
        F.when(F.col("value") > 5, F.col("value")).alias("a"),
        F.nullif(F.col("event_type"), F.lit("view")).alias("b"),
    )
    kept, aside = filters.complete_rows(v, ["a", "b"])
    return kept.withColumn("complete", F.lit(True)).unionByName(aside.withColumn("complete", F.lit(False)))


@query(
    "FLT-04",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem
    WHERE l_returnflag <> 'N' AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'
    """,
    days="l_shipdate",
)
def dates_in_period(t):
    line = t.lineitem.withColumn("l_shipdate", F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")))
    return filters.in_period(line, "l_shipdate", "1997-01-01", "1998-06-30").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"
    )


@query(
    "FLT-05",
    """
    SELECT event_id, event_type || CASE WHEN user_id % 4 = 0 THEN ' Dept of Roads' WHEN user_id % 4 = 1 THEN ' Farm'
      ELSE ' Texas Unemployment Commission' END AS opponent
    FROM events WHERE user_id % 4 = 1
    UNION ALL SELECT event_id, NULL FROM events WHERE user_id % 4 = 3
    """,
)
def no_institutions(t):
    tail = (
        F.when(F.col("user_id") % 4 == 0, F.lit(" Dept of Roads"))
        .when(F.col("user_id") % 4 == 1, F.lit(" Farm"))
        .when(F.col("user_id") % 4 == 2, F.lit(" Texas Unemployment Commission"))
    )
    named = t.events.select("event_id", F.concat("event_type", tail).alias("opponent"))
    return filters.without_institutions(named, "opponent")


@query(
    "FLT-06",
    """
    SELECT doc_id FROM documents WHERE lang <> 'fr'
      AND NOT regexp_matches(text, 'compensación|ocupación|pago|transporte|reglas|contrato|horastrabajadores|parte|tarifas|cuartos|trabajo|registros|adicionales|comidas|empleo|terminación|vivienda|empleador|frecuencia|producción|liquidación|comida|herramientas|prueba|diaria|parado|cobertura|proporcionados|abandono|deducciones|causa|garantías|divulgación|política|disciplina|despidos|derechos|imposibilidad|detalles|bloqueo|ganancias|pedidos|oportunidad')
    """,
)
def no_translated_sections(t):
    docs = t.documents.withColumn("text", F.when(F.col("lang") != "fr", F.col("text")))
    return filters.without_marker_words(docs, "text").select("doc_id")


@query(
    "FLT-07",
    """
    SELECT DISTINCT text FROM documents
    WHERE contains(text, 'ing') AND contains(text, 'tion') AND contains(text, 'ble') ORDER BY text LIMIT 5
    """,
)
def keyword_examples(t):
    return filters.example_texts(t.documents, "text", ["ing", "tion", "ble"], 5)


@query(
    "FLT-08",
    """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
      SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 5 AND count(DISTINCT upper(o_orderpriority)) > 4)
    """,
)
def groups_by_condition(t):
    return filters.groups_where(
        t.orders,
        "o_custkey",
        F.count_distinct("o_orderkey") > 5,
        F.count_distinct(F.upper("o_orderpriority")) > 4,
    ).select("o_orderkey", "o_custkey")


@query(
    "FLT-09",
    """
    SELECT p_brand, p_type, n AS count_rows FROM (
      SELECT p_brand, p_type, count(*) AS n, max(count(*)) OVER (PARTITION BY p_brand) AS m FROM part GROUP BY 1, 2) WHERE n = m
    """,
)
def most_frequent_values(t):
    return filters.most_frequent_per_group(t.part, "p_brand", "p_type")


@query(
    "FLT-10",
    """
    WITH v AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 7 = 0 THEN 0.0::DOUBLE ELSE l_tax END AS v FROM lineitem)
    SELECT * FROM v WHERE l_suppkey NOT IN (SELECT l_suppkey FROM v GROUP BY 1 HAVING bool_and(v = 0))
    """,
)
def no_flat_groups(t):
    v = t.lineitem.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_suppkey") % 7 == 0, F.lit(0.0)).otherwise(F.col("l_tax")).alias("v"),
    )
    return filters.without_flat_groups(v, "l_suppkey", "v")


@query(
    "FLT-11",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_quantity - 10 > 0 AND year(l_shipdate) BETWEEN 1996 AND 1999
    """,
)
def positive_counts_in_years(t):
    line = t.lineitem.withColumn("cnt", F.col("l_quantity") - 10)
    return filters.counted_in_years(line, "cnt", "l_shipdate", 1996, 1999).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )


@query(
    "FLT-12",
    """
    SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')
    """,
)
def certified_only(t):
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("Determination Issued - Certification"))
        .when(F.col("o_orderstatus") == "P", F.lit("Determination Issued - Partial Certification"))
        .otherwise(F.lit("Determination Issued - Certification - Withdrawn"))
    )
    return filters.with_status(
        t.orders.withColumn("status", status), "status", ["- CERTIFICATION", "- PARTIAL CERTIFICATION"]
    ).select("o_orderkey")


@query(
    "FLT-13",
    """
    SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN value > 8 END, false) AS is_accurate FROM events
    """,
)
def quality_split(t):
    rule = F.when(F.col("event_type") != "error", F.col("value") > 8)
    good, rejects = filters.split_by_rule(t.events, rule)
    return good.unionByName(rejects).select("event_id", "is_accurate")
