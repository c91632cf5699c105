"""Ids, ranks, fills, top cuts, samples and key sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import groups, order
from workload.registry import query


@query(
    "W-01",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id FROM lineitem",
)
def sequential_ids(t):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    by = [F.col(c).asc() for c in ["l_shipdate", *ids]]
    return order.row_positions(t.lineitem.select(*ids, "l_shipdate"), by, out="row_id").drop("l_shipdate")


@query(
    "W-02 RL-10",
    """
    SELECT o_custkey, o_orderkey, d FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d NULLS LAST, o_orderkey) AS n FROM (
        SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS d FROM orders)) WHERE n = 1
    """,
    days="d",
)
def earliest_of_group(t):
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
    df = t.orders.select("o_custkey", "o_orderkey", day.alias("d"))
    return groups.earliest_of_group(df, "o_custkey", "d", "o_orderkey")


@query(
    "W-03 RL-09",
    """
    SELECT o_orderkey, o_custkey::VARCHAR || '_' || dense_rank() OVER (PARTITION BY o_custkey ORDER BY state NULLS LAST)::VARCHAR AS group_id
    FROM (SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '3-MEDIUM') AS state FROM orders)
    """,
)
def groups_split_by_state(t):
    df = t.orders.select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("state"))
    return groups.split_groups_by(df, "o_custkey", "state", "group_id").select("o_orderkey", "group_id")


@query(
    "W-04",
    """
    WITH v AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v, CASE WHEN event_type = 'signup' THEN event_id END AS s FROM events)
    SELECT event_id, user_id,
      coalesce(last_value(v IGNORE NULLS) OVER d, first_value(v IGNORE NULLS) OVER u) AS v, coalesce(last_value(s IGNORE NULLS) OVER d, first_value(s IGNORE NULLS) OVER u) AS s
    FROM v WINDOW d AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    """,
)
def filled_down_and_up(t):
    kind = F.col("event_type")
    v = t.events.select(
        "event_id", "user_id", "ts",
        F.when(kind == "purchase", F.col("value")).alias("v"), F.when(kind == "signup", F.col("event_id")).alias("s"),
    )
    return order.fill_in_group(v, ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()], ["v", "s"]).drop("ts")


@query(
    "W-05",
    """
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place,
      rank() OVER w + (count(*) OVER (PARTITION BY o_orderstatus, floor(o_totalprice / 1000)) - 1) / 2.0::DOUBLE AS mean_rank
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000) DESC)
    """,
)
def ranks_two_ways(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.floor(F.col("o_totalprice") / 1000).alias("thousands"))
    placed = order.row_positions(df, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], ["o_orderstatus"], "place")
    return order.average_rank(placed, ["o_orderstatus"], "thousands", "mean_rank").select("o_orderkey", "place", "mean_rank")


@query(
    "W-06",
    """
    SELECT event_id, event_type AS model, n AS rank_score, n <= round_even(0.05 * c, 0) AS is_top FROM (
      SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)
    """,
)
def top_five_percent(t):
    df = t.events.select("event_id", F.col("event_type").alias("model"), "value")
    return groups.top_fraction(df, "model", "value", "event_id").drop("value")


@query(
    "W-07",
    """
    SELECT o_orderkey, (SELECT count(DISTINCT coalesce(nullif(x.o_orderpriority, '5-LOW'), '?')) FROM orders x WHERE x.o_custkey = o.o_custkey AND year(x.o_orderdate) = year(o.o_orderdate)) = 1 AS is_single
    FROM orders o
    """,
)
def single_value_groups(t):
    df = t.orders.select(
        "o_orderkey", F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("buyer_year"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p")
    )
    return groups.single_value_groups(df, "buyer_year", "p").select("o_orderkey", "is_single")


@query(
    "W-08 AG-16",
    """
    WITH m AS (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, l_suppkey) AS n FROM m)
    SELECT l_suppkey, max(n) FILTER (l_returnflag = 'A') AS A, max(n) FILTER (l_returnflag = 'R') AS R FROM r GROUP BY 1
    """,
)
def compared_ranks(t):
    sums = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    return groups.compare_ranks(sums, "l_returnflag", "l_suppkey", "v", ["A", "R"])


@query("ST-01 ST-02", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_twenty(t):
    by = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    return groups.top_rows(t.orders, by, 20, F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("ST-03", "SELECT doc_id, length(text)::INTEGER AS n FROM documents ORDER BY length(text) DESC, doc_id LIMIT 5")
def longest_texts(t):
    return groups.longest_texts(t.documents, "text", "doc_id", 5).select("doc_id", F.length("text").alias("n"))


@query("ST-04", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 50")
def seeded_sample(t):
    return groups.fixed_sample(t.documents, "doc_id", 50, 7).select("doc_id")


@query(
    "ST-05",
    "SELECT lang, doc_id, n AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3",
)
def top_per_group(t):
    out = groups.top_per_group(t.documents, ["lang"], [F.col("n_chars").desc(), F.col("doc_id").asc()], 3)
    return out.select("lang", "doc_id", F.col("place").cast("long").alias("place"))


@query("SET-02", "SELECT DISTINCT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND year(l_shipdate) = 1997")
def key_difference(t):
    sold = t.lineitem.where("l_returnflag = 'R' AND year(l_shipdate) = 1997").select(F.col("l_partkey").alias("p_partkey"))
    return groups.keys_only_in(t.part, sold, "p_partkey")


@query(
    "SET-03",
    """
    SELECT upper(regexp_extract(url, '//([^/]+)/', 1)) AS key FROM pages WHERE starts_with(url, 'https:')
    INTERSECT SELECT upper(regexp_extract(url, '//([^/]+)/', 1)) FROM pages WHERE starts_with(url, 'http:')
    """,
)
def key_intersection(t):
    host = t.pages.select("url", F.regexp_extract("url", "//([^/]+)/", 1).alias("host"))
    secure, plain = F.col("url").startswith("https:"), F.col("url").startswith("http:")
    return groups.shared_keys(host.where(secure), host.where(plain), "host", "host")


@query(
    "SET-04",
    """
    WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
    b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
    SELECT c_custkey, CASE WHEN a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL THEN 'Both' WHEN a.o_custkey IS NOT NULL THEN 'First only'
      WHEN b.o_custkey IS NOT NULL THEN 'Second only' ELSE 'Neither' END AS category
    FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey
    """,
)
def key_categories(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return groups.key_category(
        t.customer, urgent.where("o_orderstatus = 'F'"), urgent.where("o_orderstatus = 'O'"), "c_custkey", ("First", "Second")
    )
