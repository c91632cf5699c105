"""Column drift, renames, stacking, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.operators.filters import in_years
from harrow.functions import dates, strings
from harrow.operators import schema
from harrow.plans import reconcile
from harrow.sources import files
from workload.registry import query

# Orders stand in for yearly application files: each year has its own headers.
SHARED = {"o_orderkey": "case_number", "CASE_NO": "case_number", "o_custkey": "employer_id"}
OWN = {
    "file_1995": {"price": "total_price"},
    "file_1996": {"price": "total_price"},
    "file_1997": {"price": "total_price"},
    "file_1998": {"cost": "total_price"},
    "file_1999": {"cost": "total_price"},
    "file_2000": {"amount": "total_price"},
    "file_2001": {"amount": "total_price"},
}


def yearly_files(t):
    def year(y, *columns):
        return t.orders.where(in_years("o_orderdate", y, y)).select(*columns)

    price = F.col("o_totalprice")
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    return {
        "file_1995": year(1995, key.alias("CASE_NO"), who, price.alias("price"), "o_orderpriority"),
        "file_1996": year(1996, "o_orderpriority", key.alias("CASE_NO"), price.alias("price"), who),
        "file_1997": year(1997, key.alias("CASE_NO"), who, price.alias("price"), "o_orderpriority"),
        "file_1998": year(1998, key, who, price.alias("cost"), "o_orderpriority", "o_orderstatus"),
        "file_1999": year(1999, key, who, price.alias("cost"), "o_orderstatus"),
        "file_2000": year(2000, key, who, price.alias("amount"), "o_orderstatus", "o_orderpriority"),
        "file_2001": year(2001, key, who, price.alias("amount"), "o_orderstatus", "o_orderpriority"),
    }


@query(
    "SCH-01 SCH-02 SCH-03 PL-02",
    """
    WITH cols(period, "column", status) AS (VALUES
      ('file_1995','CASE_NO','kept'), ('file_1995','o_custkey','common'), ('file_1995','price','kept'),
      ('file_1995','o_orderpriority','kept'),
      ('file_1996','CASE_NO','kept'), ('file_1996','o_custkey','common'), ('file_1996','price','kept'),
      ('file_1996','o_orderpriority','kept'),
      ('file_1997','CASE_NO','kept'), ('file_1997','o_custkey','common'), ('file_1997','price','kept'),
      ('file_1997','o_orderpriority','kept'),
      ('file_1998','o_orderkey','new'), ('file_1998','o_custkey','common'), ('file_1998','cost','new'),
      ('file_1998','o_orderpriority','kept'), ('file_1998','o_orderstatus','new'),
      ('file_1999','o_orderkey','kept'), ('file_1999','o_custkey','common'), ('file_1999','cost','kept'),
      ('file_1999','o_orderstatus','kept'),
      ('file_2000','o_orderkey','kept'), ('file_2000','o_custkey','common'), ('file_2000','amount','new'),
      ('file_2000','o_orderstatus','kept'), ('file_2000','o_orderpriority','new'),
      ('file_2001','o_orderkey','kept'), ('file_2001','o_custkey','common'), ('file_2001','amount','kept'),
      ('file_2001','o_orderstatus','kept'), ('file_2001','o_orderpriority','kept'))
    SELECT period, "column", status, count(*) AS filled
    FROM cols JOIN orders ON period = 'file_' || year(o_orderdate)::VARCHAR
    GROUP BY ALL
    """,
)
def column_drift(t):
    return reconcile.drift_with_fill(yearly_files(t))


@query(
    "SCH-04 SCH-06 SCH-07 SCH-10 PL-01",
    """
    SELECT o_orderkey AS case_number, o_custkey AS employer_id, o_totalprice AS total_price,
           'file_' || year(o_orderdate)::VARCHAR AS data_source
    FROM orders
    """,
)
def reconciled_years(t):
    return reconcile.reconcile_periods(yearly_files(t), SHARED, OWN)


@query(
    "SCH-05 SCH-06 SET-01",
    """
    SELECT o_orderkey AS case_number, o_custkey AS employer_id, o_totalprice AS total_price,
           CASE WHEN year(o_orderdate) <> 1999 THEN o_orderpriority END AS o_orderpriority,
           CASE WHEN year(o_orderdate) > 1997 THEN o_orderstatus END AS o_orderstatus,
           'file_' || year(o_orderdate)::VARCHAR AS data_source
    FROM orders
    """,
)
def stacked_years_all_columns(t):
    return reconcile.reconcile_periods(yearly_files(t), SHARED, OWN, common_only=False)


@query(
    "SCH-08",
    """
    SELECT c_custkey AS case_number, c_name AS "_lead_name", c_acctbal AS balance_usd, c_mktsegment AS balance_usd_2
    FROM customer
    """,
)
def cleaned_headers(t):
    messy = t.customer.select(
        F.col("c_custkey").alias(" Case # "),
        F.col("c_name").alias("(Lead Name)"),
        F.col("c_acctbal").alias("Balance USD"),
        F.col("c_mktsegment").alias("balance  usd?"),
    )
    return schema.clean_names(messy).withColumnsRenamed({"case_number": "case_number", "lead_name": "_lead_name"})


@query(
    "SCH-09 W-01",
    """
    SELECT s_suppkey AS party_id, s_name AS party_name, s_nationkey,
           row_number() OVER (ORDER BY s_suppkey) AS row_index
    FROM supplier
    """,
)
def crosswalk_rename(t):
    from harrow.operators.order import row_positions

    # a header that the table lacks is in the crosswalk too
    long = t.spark.createDataFrame([("s_suppkey",), ("s_name",), ("s_gone",)], "old_name string")
    crosswalk = long.select(
        F.lit("supplier").alias("source"),
        "old_name",
        F.when(F.col("old_name") == "s_suppkey", F.lit("party_id"))
        .when(F.col("old_name") == "s_name", F.lit("party_name"))
        .otherwise(F.lit("gone"))
        .alias("new_name"),
    )
    renamed = schema.rename_by_crosswalk(t.supplier, crosswalk, "supplier").drop("s_acctbal")
    return row_positions(renamed, [F.col("party_id").asc()], out="row_index")


@query(
    "SCH-11 SCH-12",
    """
    SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
    """,
)
def columns_by_pattern(t):
    line = schema.drop(t.lineitem, ["l_partkey", "not_there"])
    wanted = [
        *schema.columns_like(line, prefix="l_order"),
        *schema.columns_like(line, suffix="date"),
        *schema.columns_like(line, pattern=r"^l_line(num|x)"),
    ]
    return schema.keep(line, wanted)


@query(
    "SCH-14",
    """
    SELECT 'p_partkey' AS "column", 'numeric' AS kind, count(DISTINCT p_partkey) AS n FROM part
    UNION ALL SELECT 'p_size', 'numeric', count(DISTINCT p_size) FROM part
    UNION ALL SELECT 'p_retailprice', 'numeric', count(DISTINCT p_retailprice) FROM part
    UNION ALL SELECT 'p_name', 'narrow text', count(DISTINCT p_name) FROM part
    UNION ALL SELECT 'p_brand', 'narrow text', count(DISTINCT p_brand) FROM part
    UNION ALL SELECT 'p_type', 'narrow text', count(DISTINCT p_type) FROM part
    """,
)
def column_kinds(t):
    part = t.part
    narrow = schema.narrow_text_columns(part, most=1000)
    kind = {c: "numeric" for c in schema.numeric_columns(part)} | {
        c: "narrow text" if c in narrow else "wide text" for c in schema.text_columns(part)
    }
    counts = part.agg(*[F.count_distinct(c).alias(c) for c in part.columns])
    label = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])
    long = counts.unpivot([], part.columns, "column", "n")
    return long.select("column", label[F.col("column")].alias("kind"), "n")


@query(
    "SRC-05",
    """
    SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d')::DATE AS current_asof FROM orders
    """,
    days="current_asof",
)
def snapshot_stamp(t):
    name = F.concat(F.lit("registry_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".csv"))
    return files.stamp_snapshot(t.orders, name).select("o_orderkey", "current_asof")


@query(
    "SRC-06",
    r"""
    WITH a AS (
      SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>((?s:.*?))</a>', 1)) AS href,
             unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>((?s:.*?))</a>', 2)) AS anchor
      FROM pages)
    SELECT page_id, href, anchor, 'https://base.example.com' || href AS link
    FROM a WHERE regexp_matches(href, '^/[A-Za-z]+') AND contains(anchor, 'th') AND NOT contains(anchor, 'ing')
    """,
)
def page_link_selection(t):
    links = files.page_links(t.pages.select("page_id", "html"))
    return files.select_links(links, r"^/[A-Za-z]+", "th", "ing", "https://base.example.com")


@query(
    "SRC-08 JN-07",
    """
    SELECT l_partkey AS partkey, count(*) AS n_lines FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE lower(trim(p_type)) = 'promo') GROUP BY 1
    """,
)
def flagged_codebook_rows(t):
    codebook = files.flagged_entries(t.part, "p_type", "promo").select(F.col("p_partkey").alias("partkey"))
    lines = t.lineitem.select(F.col("l_partkey").alias("partkey"))
    return lines.join(codebook, "partkey", "left_semi").groupBy("partkey").agg(F.count("*").alias("n_lines"))


@query(
    "SRC-09 JS-01",
    """
    SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k,
           json_extract_string(props, '$.absent.deep') AS absent
    FROM events
    """,
)
def nested_fields(t):
    props = F.col("props")
    return t.events.select(
        "event_id",
        files.json_field(props, "$.k", "bigint").alias("k"),
        files.json_field(props, "$.absent.deep", "string").alias("absent"),
    )


@query(
    "SRC-09 JN-19",
    """
    SELECT event_id, round((user_id % 90)::DOUBLE + value / 100, 6) AS geo_lat, -value AS geo_long,
           CASE WHEN event_type = 'error' THEN 'none' ELSE 'rooftop' END AS geo_accuracy_type
    FROM events
    """,
)
def first_geocode_result(t):
    # a response document is built per event, then read back as the service's answer
    answer = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("value").alias("accuracy"),
                    F.when(F.col("event_type") == "error", F.lit("none")).otherwise(F.lit("rooftop")).alias("accuracy_type"),
                    F.struct(
                        F.round((F.col("user_id") % 90).cast("double") + F.col("value") / 100, 6).alias("lat"),
                        (-F.col("value")).alias("lng"),
                    ).alias("location"),
                ),
                F.struct(
                    F.lit(0.0).alias("accuracy"),
                    F.lit("second").alias("accuracy_type"),
                    F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng")).alias("location"),
                ),
            ).alias("results")
        )
    )
    return files.first_geocode(t.events.select("event_id", answer.alias("response")), "response").select(
        "event_id", "geo_lat", "geo_long", "geo_accuracy_type"
    )
