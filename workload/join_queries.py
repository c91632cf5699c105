"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators import joins
from harrow.plans import staffing
from workload.registry import query


@query(
    "JN-01 JN-02 JN-17",
    """
    SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING'
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    """,
)
def left_joins(t):
    buyers = t.customer.where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_nationkey")
    return (
        t.orders.select("o_orderkey", "o_custkey")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("o_orderkey", "c_name", "n_name", "r_name")
    )


@query(
    "JN-02",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
)
def inner_join(t):
    return t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand"
    )


@query(
    "JN-03",
    """
    SELECT c_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    RIGHT JOIN customer ON o_custkey = c_custkey
    """,
)
def right_join(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return urgent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "n")


@query(
    "JN-04",
    """
    SELECT coalesce(a.k, b.k) AS k, n_cust, n_supp FROM
      (SELECT c_nationkey AS k, count(*) AS n_cust FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) a
      FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_supp FROM supplier GROUP BY 1) b ON a.k = b.k
    """,
)
def full_join_by_key(t):
    a = t.customer.where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_cust"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_supp"))
    return joins.full_by_key(a, b, ["k"])


@query(
    "JN-05 AG-01",
    """
    WITH m AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS merge FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT merge, count(*) AS n, count(*) / (SELECT count(*) FROM m) AS share FROM m GROUP BY 1
    """,
)
def join_indicator_shares(t):
    from harrow.operators.aggregates import frequency

    merged = joins.join_with_indicator(t.documents.select("doc_id"), t.labels.select("doc_id"), ["doc_id"], "merge")
    return frequency(merged, ["merge"], share="share")


@query("JN-06", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)")
def anti_join(t):
    big = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.rows_without(t.customer, big, ["c_custkey"]).select("c_custkey")


@query("JN-07", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def semi_join(t):
    sold = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return joins.rows_with(t.part, sold, ["p_partkey"]).select("p_partkey")


@query(
    "JN-08",
    """
    SELECT o.o_custkey AS group_id, o.o_orderkey, s.s_suppkey FROM orders o JOIN supplier s ON o.o_custkey = s.s_suppkey % 40
    """,
)
def many_to_many(t):
    cases = t.supplier.select((F.col("s_suppkey") % 40).alias("group_id"), "s_suppkey")
    jobs = t.orders.select(F.col("o_custkey").alias("group_id"), "o_orderkey")
    return jobs.join(cases, "group_id")


@query(
    "JN-09",
    """
    SELECT c_nationkey AS k, c_custkey AS id_customer, c_acctbal AS bal_customer, s_suppkey AS id_supplier, s_acctbal AS bal_supplier
    FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey
    """,
)
def side_suffixes(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    b = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return joins.join_with_suffixes(a, b, ["k"], "left", ("_customer", "_supplier"))


@query(
    "JN-10 SCH-10",
    """
    WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS party, o_totalprice AS amount FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'),
    b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority <> '5-LOW' THEN 'second ' || o_orderstatus END AS party, -o_totalprice AS amount FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01')
    SELECT a.k, coalesce(a.party, b.party) AS party, coalesce(a.amount, b.amount) AS amount,
      CASE WHEN a.party IS NULL AND b.party IS NULL THEN 'missing in both' WHEN a.party IS NULL THEN 'b' ELSE 'a' END AS source
    FROM a LEFT JOIN b ON a.k = b.k
    UNION ALL SELECT k, party, amount, 'b_only' FROM b WHERE k NOT IN (SELECT k FROM a)
    """,
)
def overlapping_sources(t):
    a = t.orders.where("o_orderdate < '1998-06-01'").select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("party"),
        F.col("o_totalprice").alias("amount"),
    )
    b = t.orders.where("o_orderdate > '1998-01-01'").select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("second "), F.col("o_orderstatus"))).alias("party"),
        (-F.col("o_totalprice")).alias("amount"),
    )
    return joins.precedence_merge(a, b, "k", ["party", "amount"], "party", ("a", "b"))


@query(
    "JN-11 DT-03",
    """
    WITH n AS (SELECT c_nationkey AS nation, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
    SELECT n_nationkey AS nation, y::INTEGER AS year, q::INTEGER AS quarter, coalesce(n.n, 0) AS n
    FROM nation, range(1995, 2002) r(y), range(1, 5) s(q) LEFT JOIN n ON n.nation = n_nationkey AND n.year = y AND n.quarter = q
    """,
)
def complete_quarters(t):
    df = t.orders.where("o_orderpriority = '1-URGENT'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    counts = df.groupBy(
        F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")
    ).agg(F.count("*").alias("n"))
    grid = joins.quarter_grid(t.nation.select(F.col("n_nationkey").alias("nation")), 1995, 2001)
    return joins.complete_counts(counts, grid, ["nation", "year", "quarter"], ["n"])


@query(
    "JN-11 PL-16",
    """
    WITH m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH))::DATE AS month)
    SELECT m.month, coalesce(n, 0) AS n FROM m LEFT JOIN (
      SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND quarter(o_orderdate) <> 2 GROUP BY 1) c ON c.month = m.month
    """,
    days="month",
)
def month_calendar_counts(t):
    grid = joins.month_calendar(t.orders, "o_orderdate")
    urgent = t.orders.where("o_orderpriority = '1-URGENT' AND quarter(o_orderdate) <> 2")
    counts = urgent.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    return joins.complete_counts(counts, grid, ["month"], ["n"])


@query(
    "JN-12 JN-11 NUM-03",
    """
    WITH staff AS (SELECT c_nationkey AS nation, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS qi, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    grid AS (SELECT n_nationkey AS nation, range AS qi FROM nation, range(1995 * 4, 2002 * 4)),
    full_staff AS (SELECT nation, qi, coalesce(n, 0) AS n FROM grid LEFT JOIN staff USING (nation, qi)),
    cases AS (SELECT s_nationkey AS nation, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS qi, count(*) AS cases
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT c.nation, c.qi::INTEGER AS quarter_index, cases, round_even(avg(f.n), 0) AS mean_staff
    FROM cases c LEFT JOIN full_staff f ON f.nation = c.nation AND f.qi BETWEEN c.qi - 4 AND c.qi - 1
    GROUP BY ALL
    """,
)
def trailing_staff(t):
    staff = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    staff = staff.groupBy(
        F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")
    ).agg(F.count("*").alias("n"))
    grid = joins.quarter_grid(t.nation.select(F.col("n_nationkey").alias("nation")), 1995, 2001)
    complete = joins.complete_counts(staff, grid, ["nation", "year", "quarter"], ["n"])
    cases = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    cases = cases.groupBy(
        F.col("s_nationkey").alias("nation"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter")
    ).agg(F.count("*").alias("cases"))
    return staffing.with_trailing_mean(cases, complete, ["nation"], "n", "mean_staff").select(
        "nation", "quarter_index", "cases", "mean_staff"
    )


@query(
    "JN-17",
    """
    SELECT s_suppkey, upper(n_name) AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 20
    """,
)
def code_look_up(t):
    codes = t.nation.where("n_nationkey < 20").select(
        F.concat(F.lit("st"), F.col("n_nationkey")).alias("code"), F.upper("n_name").alias("name")
    )
    coded = t.supplier.select("s_suppkey", F.concat(F.lit("ST"), F.col("s_nationkey")).alias("loc"))
    return joins.look_up(coded, "loc", codes, "code", "name", "state").select("s_suppkey", "state")


@query(
    "JN-18",
    """
    SELECT c_custkey, sum_price FROM customer LEFT JOIN
      (SELECT o_custkey, round(sum(o_totalprice), 2) AS sum_price FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey
    """,
)
def required_keys_back(t):
    sums = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("sum_price")
    )
    return joins.add_missing_keys(sums, t.customer, ["c_custkey"])


@query(
    "JN-19",
    """
    SELECT o_orderkey, o_custkey, CASE WHEN c_acctbal > 5000 THEN 'cache' ELSE 'fresh' END AS origin, c_name AS answer
    FROM orders JOIN customer ON o_custkey = c_custkey
    """,
)
def enriched_distinct_keys(t):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("answer"), "c_acctbal")
    cache = customers.where("c_acctbal > 5000").select("o_custkey", F.lit("cache").alias("origin"), "answer")

    def look(keys):
        return keys.join(customers, "o_custkey").select("o_custkey", F.lit("fresh").alias("origin"), "answer")

    orders = t.orders.select("o_orderkey", "o_custkey")
    return joins.enrich_distinct(orders, "o_custkey", cache, look)


@query(
    "JN-20 NUM-01 PL-08",
    """
    SELECT p_brand, count(DISTINCT l_orderkey) AS n_units, count(DISTINCT CASE WHEN l_returnflag = 'R' AND l_quantity > 30 THEN l_orderkey END) AS n_hits,
      count(DISTINCT CASE WHEN l_returnflag = 'R' AND l_quantity > 30 THEN l_orderkey END) / count(DISTINCT l_orderkey) AS share
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
    """,
)
def share_with_condition(t):
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    hit = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30)
    return joins.grouped_share(df, ["p_brand"], "l_orderkey", hit)


@query(
    "JN-20 AG-06",
    """
    SELECT a.o_orderpriority, a.o_orderstatus, num, denom, num / denom AS share FROM
      (SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey) AS num FROM orders GROUP BY ALL) a
      JOIN (SELECT o_orderpriority, count(DISTINCT o_custkey) AS denom FROM orders GROUP BY ALL) b ON a.o_orderpriority = b.o_orderpriority
    """,
)
def share_of_coarser_group(t):
    return joins.share_of_coarser(t.orders, ["o_orderpriority", "o_orderstatus"], ["o_orderpriority"], "o_custkey")


@query(
    "JN-21",
    """
    WITH pairs AS (SELECT c_custkey, s_suppkey, c_nationkey, replace(c_name, 'Customer', '') AS cn, replace(s_name, 'Supplier', '') AS sn, c_mktsegment,
        c_acctbal > 5000 AS cd, s_acctbal > 5000 AS sd
      FROM customer JOIN supplier ON c_custkey = s_suppkey)
    SELECT c_custkey, s_suppkey, cn = sn AS exact_name, cd = sd AS exact_date, cn = sn OR cd = sd AS exact_either FROM pairs
    """,
)
def match_quality_flags(t):
    pairs = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey")).select(
        "c_custkey", "s_suppkey",
        F.replace("c_name", F.lit("Customer"), F.lit("")).alias("cn"),
        F.replace("s_name", F.lit("Supplier"), F.lit("")).alias("sn"),
        (F.col("c_acctbal") > 5000).alias("cd"), (F.col("s_acctbal") > 5000).alias("sd"),
    )
    return joins.match_quality(pairs, ("cn", "sn"), ("cd", "sd")).drop("cn", "sn", "cd", "sd")


@query(
    "JN-21 RL-12",
    """
    SELECT count(*) AS links, count(DISTINCT o_orderkey) AS left_ids, count(DISTINCT o_custkey) AS right_ids,
      count(*) = count(DISTINCT o_orderkey) AND count(*) = count(DISTINCT o_custkey) AS is_one_to_one FROM orders
    """,
)
def one_to_one(t):
    return joins.one_to_one_check(t.orders, "o_orderkey", "o_custkey")
