"""Whole studies on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import strings
from harrow.operators import features, linkage, models
from harrow.operators import aggregates as agg
from harrow.plans import addresses, intake, linking, outcomes, profiles, staffing, tracts, trends
from workload.linkage_queries import named_pages
from workload.registry import query
from workload.spatial_queries import diamonds


def employer_jobs_and_cases(t):
    """Parts are employers, brands their states; lines are jobs, returned lines are cases."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    name = strings.clean_company_name(F.concat("p_name", F.lit(" LLC"))).alias("name")
    start = F.col("l_shipdate").cast("date")
    jobs = lines.where("l_returnflag = 'N'").select(
        F.col("p_brand").alias("state"), name, start.alias("start"), F.date_add(start, 60).alias("end")
    )
    cases = lines.where("l_returnflag = 'R'").select(F.col("p_brand").alias("state"), name, start.alias("found"))
    return jobs, cases


@query(
    "JN-13 BL-01 AG-05 STR-02 PL-08",
    """
    WITH l AS (SELECT p_brand AS state, upper(p_name) AS name, l_shipdate::DATE AS d, l_returnflag AS f FROM lineitem JOIN part ON l_partkey = p_partkey),
    j AS (SELECT DISTINCT state, name, d AS s, d + 60 AS e FROM l WHERE f = 'N'), c AS (SELECT DISTINCT state, name, d FROM l WHERE f = 'R'),
    n AS (SELECT DISTINCT a.state, a.name AS jn, b.name AS cn FROM j a JOIN c b ON a.state = b.state AND jaro_winkler_similarity(a.name, b.name) >= 0.85),
    h AS (SELECT DISTINCT j.state, j.name, j.s FROM j JOIN n ON n.state = j.state AND n.jn = j.name JOIN c ON c.state = n.state AND c.name = n.cn AND c.d BETWEEN j.s AND j.e)
    SELECT year(j.s)::INTEGER AS year, count(DISTINCT j.state || '|' || j.name) AS employers, count(DISTINCT CASE WHEN h.s IS NOT NULL THEN j.state || '|' || j.name END) AS with_case,
      count(DISTINCT CASE WHEN h.s IS NOT NULL THEN j.state || '|' || j.name END) / count(DISTINCT j.state || '|' || j.name) AS share
    FROM j LEFT JOIN h ON h.state = j.state AND h.name = j.name AND h.s = j.s GROUP BY 1
    """,
)
def employers_with_case_by_year(t):
    from harrow.operators.joins import grouped_share

    jobs, cases = employer_jobs_and_cases(t)
    match = linkage.fuzzy_join(jobs, cases, ["state"], ["name"], 0.85)
    # cases under the names of the jobs they match
    known = match.select("state", F.col("name_r").alias("name"), F.col("name_l").alias("job_name"))
    matched = cases.distinct().join(known, ["state", "name"]).select("state", F.col("job_name").alias("name"), "found")

    def employer(df):
        return df.withColumn("employer", F.concat_ws("|", "state", "name")).drop("state", "name")

    flagged = outcomes.windows_with_event(employer(jobs), employer(matched), "employer", "start", "end", "found", "hit")
    by_year = flagged.withColumn("year", F.year("start"))
    return grouped_share(by_year, ["year"], "employer", F.col("hit"), "employers", "with_case", "share")


@query("PL-03 RL-08 RL-09 RL-10 RL-11 W-02")
def linked_and_expanded(t):
    def plain(c):
        return F.upper(c)

    pages = named_pages(t).join(t.pages.select("page_id", F.length("html").alias("n")), "page_id")
    jobs = pages.where(F.col("url").startswith("https:")).select(
        F.col("page_id").alias("job_row"), F.col("name").alias("job_name"), F.col("lang").alias("job_state"), F.col("name").alias("job_city"), "n"
    )
    cases = pages.where(F.col("url").startswith("http:")).select(
        F.col("page_id").alias("case_row"), F.col("name").alias("case_name"), F.col("lang").alias("case_state"), F.col("name").alias("case_city"), F.col("n").alias("m")
    )
    out = linking.link_records(
        jobs, cases, linking.Side("job_row", "job_name", "job_city", "job_state", "n"),
        linking.Side("case_row", "case_name", "case_city", "case_state", "m"), clean=plain,
    )
    return out["expanded"].select("job_row", "case_row", "job_group", "case_group", "is_matched")


@query(
    "PL-04 JN-10 STR-14 STR-15 FLT-05 AG-21 AG-22",
    """
    WITH a AS (SELECT o_orderkey AS case_number, o_orderdate::DATE AS date,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'Farm ' || o_custkey::VARCHAR WHEN o_orderpriority = '2-HIGH' THEN 'Dept of ' || o_custkey::VARCHAR END AS opponent,
        CASE WHEN o_orderstatus <> 'P' THEN 'S' || o_orderstatus END AS opponent_state FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '2000-06-30'),
    lists AS (SELECT o_orderkey AS case_number, o_orderdate::DATE AS date, list('Farm ' || l_partkey::VARCHAR ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS o,
        list('S' || l_suppkey::VARCHAR ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) FILTER (l_returnflag <> 'R') AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    b AS (SELECT case_number, date, unnest(o) AS opponent, unnest(s) AS opponent_state FROM lists WHERE len(o) = len(s)),
    m AS (SELECT a.case_number, coalesce(a.date, b.date) AS date, coalesce(a.opponent, b.opponent) AS opponent, coalesce(a.opponent_state, b.opponent_state) AS opponent_state FROM a LEFT JOIN b ON a.case_number = b.case_number
      UNION ALL SELECT * FROM b WHERE date >= DATE '1998-01-01' AND case_number NOT IN (SELECT case_number FROM a)),
    f AS (SELECT *, bool_and(opponent IS NULL) OVER (PARTITION BY case_number) AS x, bool_and(opponent_state IS NULL) OVER (PARTITION BY case_number) AS y FROM m)
    SELECT DISTINCT case_number, date, opponent, opponent_state FROM f WHERE NOT x AND NOT y AND coalesce(NOT contains(opponent, 'Dept'), true)
    """,
    days="date",
)
def cleaned_intake(t):
    day = F.col("o_orderdate").cast("date")
    first = t.orders.where("o_orderdate <= '2000-06-30'").select(
        F.col("o_orderkey").alias("case_number"), day.alias("date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Farm "), "o_custkey")).alias("org"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Dept of "), "o_custkey")).alias("lead_org"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("S"), "o_orderstatus")).alias("ap_state"),
    )
    first = intake.settle_opponent(first, [("org", "AP org"), ("lead_org", "Lead AP org")], ["ap_state"])
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    cell = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    lists = lines.groupBy(F.col("o_orderkey").alias("case_number"), day.alias("date")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    kept = F.filter("c", lambda x: x["l_returnflag"] != "R")
    second = lists.select(
        "case_number", "date",
        F.array_join(F.transform("c", lambda x: F.concat(F.lit("Farm "), x["l_partkey"])), "\r").alias("opponents"),
        F.array_join(F.transform(kept, lambda x: F.concat(F.lit("S"), x["l_suppkey"])), ",").alias("states"),
    ).where("states <> ''")
    second = intake.spread_opponents(second, "opponents", "states")
    merged = intake.merge_pulls(first, second, "case_number", "date", "1998-01-01")
    return intake.employers_only(merged, "case_number")


@query(
    "PL-05 AG-16 AG-17 AG-20 NUM-02 JN-18 SRC-08",
    """
    WITH w AS (SELECT l_suppkey AS area, count(*)::DOUBLE AS B1_001, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS B1_002, count(*) FILTER (l_returnflag = 'A')::DOUBLE AS B1_003,
        sum(l_quantity) AS B2_001, sum(l_quantity) FILTER (l_linestatus = 'O') AS B2_002, max(l_extendedprice) - 60000 AS B3_001 FROM lineitem GROUP BY 1)
    SELECT s_suppkey AS area, B1_002 / B1_001 * 100 AS "B1_002", B1_003 / B1_001 * 100 AS "B1_003", B2_002 / B2_001 * 100 AS "B2_002",
      CASE WHEN B3_001 >= 0 THEN B3_001 END AS "B3_001" FROM supplier LEFT JOIN w ON area = s_suppkey
    """,
)
def area_predictors(t):
    wide = t.lineitem.groupBy(F.col("l_suppkey").alias("area")).agg(
        F.count("*").cast("double").alias("B1_001"),
        F.count_if(F.col("l_returnflag") == "R").cast("double").alias("B1_002"),
        F.count_if(F.col("l_returnflag") == "A").cast("double").alias("B1_003"),
        F.sum("l_quantity").alias("B2_001"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("B2_002"),
        (F.max("l_extendedprice") - 60000).alias("B3_001"),
    )
    percent = ["B1_001", "B1_002", "B1_003", "B2_001", "B2_002"]
    # the codebook lists the table's own variables
    codebook = t.spark.createDataFrame([(v,) for v in percent], "name string")
    required = t.supplier.select(F.col("s_suppkey").alias("area"))
    return tracts.area_predictors(wide, "area", codebook, percent, ["B3_001"], required)


@query(
    "PL-06 STR-06 JN-19 JN-16 JN-01",
    """
    WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    c AS (SELECT label AS area, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(stddev_samp(x), 4) AS r FROM e GROUP BY 1),
    v AS (SELECT label AS area, count(*) AS n_vectors FROM embeddings GROUP BY 1)
    SELECT o_orderkey, c.area, n_vectors FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN e ON vec_id = c_custkey
      LEFT JOIN c ON abs(x - cx) + abs(y - cy) <= r LEFT JOIN v ON v.area = c.area
    """,
)
def located_orders(t):
    buyer = t.customer.select("c_custkey", strings.full_address(F.col("c_name"), F.lit("Town"), F.lit("ST"), F.col("c_custkey").cast("string")).alias("address"))
    rows = t.orders.join(buyer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "address")
    points = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    answers = buyer.join(points, F.col("c_custkey") == F.col("vec_id")).select("address", "x", "y", "c_custkey")
    cache = answers.join(t.customer.where("c_acctbal > 0").select("c_custkey"), "c_custkey", "left_semi").select("address", "x", "y")

    def geocode(keys):
        return keys.join(answers.select("address", "x", "y"), "address", "left")

    located = addresses.locate(rows, "address", cache, geocode, diamonds(t), "x", "y", "rings")
    predictors = t.embeddings.groupBy(F.lit("one").alias("source"), F.col("label").alias("area")).agg(F.count("*").alias("n_vectors"))
    out = addresses.with_area_predictors(located.withColumn("source", F.lit("one")), predictors, "source", "area")
    return out.select("o_orderkey", "area", "n_vectors")


@query(
    "PL-07 BL-01 BL-02 DT-02 JN-01",
    """
    WITH j AS (SELECT l_orderkey, o_orderdate + INTERVAL 30 DAY AS s, o_orderdate + INTERVAL 75 DAY AS e, l_returnflag = 'R' AS m, l_shipdate AS d, l_quantity - 25 AS q, l_tax AS x, l_discount AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    a AS (SELECT l_orderkey, bool_or(m AND d BETWEEN s AND e) AS finding_in_window, bool_or(m AND d BETWEEN s AND e AND (q > 0 OR x > 0 OR y <> 0)) AS any_violation_in_window FROM j GROUP BY 1),
    b AS (SELECT o_orderkey AS l_orderkey, o_totalprice > 250000 AND o_orderdate >= TIMESTAMP '1997-01-01' AS intake_after_start FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT a.*, intake_after_start, CASE WHEN finding_in_window AND intake_after_start THEN 'Both A and B' WHEN finding_in_window AND NOT intake_after_start THEN 'A; not B'
      WHEN NOT finding_in_window AND intake_after_start THEN 'B; not A' ELSE 'Neither A nor B' END AS source_category FROM a LEFT JOIN b USING (l_orderkey)
    """,
)
def outcome_table(t):
    orders = t.orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.col("o_orderdate") + F.expr("interval 30 day")).alias("start"), (F.col("o_orderdate") + F.expr("interval 75 day")).alias("end"),
    )
    linked = t.lineitem.join(orders, "l_orderkey").withColumns(
        {"matched": F.col("l_returnflag") == "R", "count_a": F.col("l_quantity") - 25}
    )
    flagged = outcomes.case_outcomes(linked, "matched", "l_shipdate", "start", "end", ["count_a", "l_tax", "l_discount"])
    jobs = outcomes.per_job(flagged, "l_orderkey", ["finding_in_window", "any_violation_in_window"])
    second = t.orders.where("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") > 250000).alias("seen"), "o_orderdate",
        F.lit("1997-01-01").cast("timestamp_ntz").alias("since"),
    )
    second = outcomes.intake_outcomes(second, "seen", "o_orderdate", "since").select("l_orderkey", "intake_after_start")
    return outcomes.compare_sources(jobs, second, "l_orderkey", "finding_in_window", "intake_after_start", ("A", "B"))


@query(
    "PL-08 AG-05 AG-17",
    """
    WITH w AS (SELECT year(o_orderdate)::INTEGER AS year, count(DISTINCT o_custkey) AS unique_employers, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS unique_employers_with_finding,
      count(DISTINCT o_orderkey) AS unique_jobs, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS unique_jobs_with_finding FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY 1)
    SELECT year, variable, value FROM w UNPIVOT (value FOR variable IN (unique_employers, unique_employers_with_finding, unique_jobs, unique_jobs_with_finding))
    """,
)
def yearly_trends(t):
    return trends.yearly_counts(
        t.orders, "o_orderdate", {"employers": "o_custkey", "jobs": "o_orderkey"}, {"finding": F.col("o_orderstatus") == "F"}, 1996, 2000
    )


@query(
    "PL-08 JN-20 STR-03 STR-04",
    """
    SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Missing' ELSE upper(c_mktsegment) || ' X' END AS agent, count(DISTINCT c_custkey) AS n_units,
      count(DISTINCT c_custkey) FILTER (c_acctbal > 5000) AS n_hits, count(DISTINCT c_custkey) FILTER (c_acctbal > 5000) / count(DISTINCT c_custkey) AS share FROM customer GROUP BY 1
    """,
)
def agent_representation(t):
    agent = F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit("   x ")))
    return trends.agent_representation(t.customer.withColumn("agent_name", agent), "agent_name", "c_custkey", F.col("c_acctbal") > 5000)


@query(
    "PL-08 FLT-09 STR-10",
    """
    WITH c AS (SELECT p_size::VARCHAR AS code, p_name, count(*) AS n FROM part GROUP BY ALL)
    SELECT code, p_name, n AS count_titles FROM (SELECT *, max(n) OVER (PARTITION BY code) AS m FROM c) WHERE n = m
    """,
)
def consolidated_titles(t):
    df = t.part.select(F.concat(F.col("p_size").cast("string"), F.lit(".00")).alias("soc"), "p_name")
    return trends.consolidated_titles(df, "soc", "p_name")


@query(
    "PL-11 AG-03 AG-04 JN-11 JN-12",
    """
    WITH f AS (SELECT c_nationkey AS nation, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, 1 AS heads, o_totalprice AS pay FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT n_nationkey AS nation, y, q, y * 4 + q - 1 AS i FROM nation, range(1995, 2002) a(y), range(1, 5) b(q) WHERE n_nationkey IN (SELECT nation FROM f)),
    h AS (SELECT g.nation, i, coalesce(count(heads), 0) AS heads FROM g LEFT JOIN f ON f.nation = g.nation AND f.year = y AND f.quarter = q GROUP BY ALL),
    c AS (SELECT s_nationkey AS nation, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter, l_extendedprice AS amount, l_linenumber AS violations FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'),
    k AS (SELECT c.*, (SELECT round_even(avg(heads), 0) FROM h WHERE h.nation = c.nation AND h.i BETWEEN c.year * 4 + c.quarter - 5 AND c.year * 4 + c.quarter - 2) AS staff FROM c)
    SELECT nation, year::INTEGER AS year, round(avg(amount), 8) AS mean_amount, sum(violations)::BIGINT AS sum_violations, round(sum(staff), 2) AS staff, round(avg(amount) / sum(violations), 6) AS amount_per_violation FROM k GROUP BY ALL
    """,
)
def staffing_panel(t):
    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"),
        F.lit(1).alias("heads"), F.col("o_totalprice").alias("pay"),
    )
    staff = staffing.staff_by_quarter(facts, ["nation"], "heads", "pay", 1995, 2001)
    cases = t.lineitem.where("l_returnflag = 'R'").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("nation"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"),
        F.col("l_extendedprice").alias("amount"), F.col("l_linenumber").alias("violations"),
    )
    lagged = staffing.with_trailing_mean(cases, staff, ["nation"], "sum_heads", "staff")
    out = staffing.yearly_panel(lagged, ["nation"], "amount", "violations", "staff")
    return out.withColumns({"mean_amount": F.round("mean_amount", 8), "staff": F.round("staff", 2), "amount_per_violation": F.round("amount_per_violation", 6)})


@query("PL-12 AG-09 FE-06 FE-08 ML-02 JN-13")
def representative_matrix(t):
    """Matched employers as one row each, encoded, and a forest's score on unseen ones."""
    dear, cheap = t.part.where("p_retailprice >= 950"), t.part.where("p_retailprice < 950")
    pairs = linkage.fuzzy_join(dear, cheap, ["p_brand"], ["p_name"])
    seen = pairs.select("p_brand", F.col("p_name_l").alias("p_name")).distinct().withColumn("_seen", F.lit(1))
    rows = dear.withColumn("employer", F.concat_ws("|", "p_brand", "p_name")).join(seen, ["p_brand", "p_name"], "left")
    matrix = agg.representative_rows(
        rows.select("employer", "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.coalesce("_seen", F.lit(0)).cast("double").alias("label")),
        "employer",
    )
    matrix = features.impute_mode(matrix, ["p_type", "p_size"])
    split = features.split_by_group(matrix, "employer").cache()
    train, test = split.where("is_train"), split.where("NOT is_train")
    encoder = features.one_hot(train, ["p_brand", "p_type"])
    inputs = ["p_brand_hot", "p_type_hot", "p_size", "p_retailprice"]
    from pyspark.ml.classification import RandomForestClassifier

    fitted = RandomForestClassifier(numTrees=100, maxDepth=20, seed=0).fit(features.assemble(encoder.transform(train), inputs))
    scored = features.assemble(encoder.transform(test), inputs)
    return models.predictions(fitted, "random_forest", scored, ["employer"])


@query(
    "PL-13 AG-12 AG-13 AG-14",
    """
    WITH s AS (SELECT 'value' AS variable, count(value)::DOUBLE AS "count", avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS p25,
      quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, max(value) AS max FROM events)
    SELECT variable, statistic, round(value, 4) AS value FROM (SELECT variable, statistic, value FROM s UNPIVOT (value FOR statistic IN ("count", mean, std, min, p25, p50, p75, max)))
    UNION ALL SELECT 'event_type', 'count', count(event_type)::DOUBLE FROM events UNION ALL SELECT 'event_type', 'unique', count(DISTINCT event_type)::DOUBLE FROM events
    UNION ALL SELECT unnest(['value', 'event_type', 'ts']), 'nulls', 0.0::DOUBLE
    UNION ALL SELECT 'ts', 'first_day', (min(ts)::DATE - DATE '1970-01-01')::DOUBLE FROM events UNION ALL SELECT 'ts', 'last_day', (max(ts)::DATE - DATE '1970-01-01')::DOUBLE FROM events
    """,
)
def table_profile(t):
    out = profiles.table_profile(t.events, ["value"], ["event_type"], ["ts"])
    return out.withColumn("value", F.round("value", 4))


@query(
    "PL-14 AG-10 AG-22 FLT-06 JN-05",
    """
    WITH u AS (SELECT conv_id, min(turn) AS turn, text FROM conversations GROUP BY conv_id, text),
    k AS (SELECT * FROM u WHERE NOT regexp_matches(text, 'trabajo|contrato|que')),
    w AS (SELECT conv_id, string_agg(replace(text, chr(10), ''), ' || ' ORDER BY turn) AS text FROM k GROUP BY 1)
    SELECT w.conv_id, 0::BIGINT AS part, text, length(text)::INTEGER AS n_chars, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS found
    FROM w LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = w.conv_id
    """,
)
def addenda_texts(t):
    facts = t.labels.select(F.col("doc_id").alias("conv_id"))
    return profiles.addenda(t.conversations, "conv_id", "turn", "text", facts, ["trabajo", "contrato", "que"])


@query(
    "PL-15 SET-03 STR-12 FLT-03 DT-01",
    """
    SELECT DISTINCT upper(replace(c_name, 'Customer#', 'ENTITY ')) AS entity FROM customer JOIN orders ON o_custkey = c_custkey
    INTERSECT SELECT upper(replace(s_name, 'Supplier#', 'ENTITY ')) FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'
    """,
)
def debarment_overlap(t):
    first = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select(
        F.replace("c_name", F.lit("Customer#"), F.lit("En-tity\n")).alias("Entity"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("Start")
    )
    second = t.supplier.join(t.lineitem.where("l_returnflag = 'R'"), F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.replace("s_name", F.lit("Supplier#"), F.lit(" entity ")).alias("Name"), F.date_format("l_shipdate", "M/d/yyyy").alias("Start date")
    )
    from harrow.functions.dates import LONG_DATE, SLASH_DATE, parse_date

    a = profiles.tidy_list(first, "Entity", parse_date(F.col("Start"), LONG_DATE), F.lit(None).cast("date"))
    b = profiles.tidy_list(second, "Name", parse_date(F.col("Start date"), SLASH_DATE), F.lit(None).cast("date"))
    return profiles.list_overlap(a, b)


@query(
    "PL-16 JN-11 AG-05 AG-17 DT-03",
    """
    WITH d AS (SELECT 'orders' AS source, o_orderdate AS d, o_custkey::VARCHAR AS id FROM orders UNION ALL SELECT 'returns', l_shipdate, l_suppkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R'),
    m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(d)) FROM d), (SELECT date_trunc('month', max(d)) FROM d), INTERVAL 1 MONTH))::DATE AS month)
    SELECT month, s.source, (SELECT count(DISTINCT id) FROM d WHERE d.source = s.source AND date_trunc('month', d.d)::DATE = month) AS n FROM m, (VALUES ('orders'), ('returns')) s(source)
    """,
    days="month",
)
def monthly_sources(t):
    returns = t.lineitem.where("l_returnflag = 'R'")
    return profiles.monthly_sources({"orders": (t.orders, "o_orderdate", "o_custkey"), "returns": (returns, "l_shipdate", "l_suppkey")})


@query(
    "PL-17 AG-23 SET-04 GEO-02 JN-01",
    """
    WITH e AS (SELECT vec_id, label AS area, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    c AS (SELECT area, round(avg(x), 4) AS lon, round(avg(y), 4) AS lat FROM e GROUP BY 1)
    SELECT c.area, round(lon, 6) AS lon, round(lat, 6) AS lat, (SELECT round(avg(y), 6) FROM e WHERE e.area = c.area) AS mean_y,
      CASE WHEN c.area IN (SELECT area FROM e WHERE x > 0.28) AND c.area IN (SELECT area FROM e WHERE y > 0.28) THEN 'Both'
        WHEN c.area IN (SELECT area FROM e WHERE x > 0.28) THEN 'East only' WHEN c.area IN (SELECT area FROM e WHERE y > 0.28) THEN 'North only' ELSE 'Neither' END AS category FROM c
    """,
)
def map_layer(t):
    e = t.embeddings.select("vec_id", F.col("label").alias("area"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    out = profiles.map_layer(
        diamonds(t), "rings", "area", e.select("vec_id", "area", "y"), "y", "vec_id", e.where("x > 0.28"), e.where("y > 0.28"), ("East", "North")
    )
    return out.withColumns({c: F.round(c, 6) for c in ("lon", "lat", "mean_y")})
