"""Text, date, number and flag expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow.functions import dates, flags, strings
from harrow.operators import text_columns as shapes
from harrow.operators.aggregates import modes
from workload.registry import query

PLACES = "|".join(strings.place_words())


def page_title():
    # engines disagree on the upper case of the sharp s, so it is spelled out first
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return F.replace(title, F.lit("ß"), F.lit("ss"))


@query(
    "STR-01",
    r"""
    SELECT o_orderkey,
           nullif(regexp_extract(upper('Determination - ' || o_orderpriority || ' - final'), '-\s(.*)$', 0), '') AS tail,
           nullif(regexp_extract(upper(o_orderpriority), '-\s(.*)$', 0), '') AS tail_or_null,
           regexp_extract('Determination - ' || o_orderpriority, '-\s(.*)$', 1) AS after
    FROM orders
    """,
)
def status_tails(t):
    long = F.concat(F.lit("Determination - "), F.col("o_orderpriority"))
    return t.orders.select(
        "o_orderkey",
        strings.status_tail(F.concat(long, F.lit(" - final"))).alias("tail"),
        strings.status_tail(F.col("o_orderpriority")).alias("tail_or_null"),
        strings.after_dash(long).alias("after"),
    )


@query(
    "STR-02",
    rf"""
    WITH raw AS (
      SELECT page_id, 'Acme ' || replace(regexp_extract(html, '<title>([^<]*)</title>', 1), 'ß', 'ss') || ' company - alabama; tx LLC inc.,' AS raw
      FROM pages),
    s AS (
      SELECT page_id, raw, regexp_replace(upper(raw), '[-;] (?:{PLACES})', '', 'g') AS u FROM raw)
    SELECT page_id,
      regexp_replace(regexp_replace(regexp_replace(u, '&NDASH| (?:LLC|CO|INC)', '', 'g'), '[[:punct:]]+$', ''), '^\s+|\s+$', '', 'g') AS name,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '&NDASH', '', 'g'), ' (?:LLC|CO|INC)([^\p{{L}}\p{{N}}_]|$)', '\1', 'g'), ' (?:LLC|CO|INC)([^\p{{L}}\p{{N}}_]|$)', '\1', 'g'), '[[:punct:]]+$', ''), '^\s+|\s+$', '', 'g') AS name_bounded
    FROM s
    """,
)
def cleaned_company_names(t):
    raw = F.concat(F.lit("Acme "), page_title(), F.lit(" company - alabama; tx LLC inc.,"))
    return t.pages.select(
        "page_id",
        strings.clean_company_name(raw).alias("name"),
        strings.clean_company_name(raw, word_bounded=True).alias("name_bounded"),
    )


@query(
    "STR-03",
    r"""
    WITH raw AS (SELECT page_id, '  ' || replace(regexp_extract(html, '<title>([^<]*)</title>', 1), 'ß', 'ss') || '   LLC.  INC. ' AS raw FROM pages)
    SELECT page_id, regexp_replace(raw, '(LLC|CO|INC)\.', '\1', 'g') AS undotted,
           regexp_replace(upper(regexp_replace(raw, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS squeezed,
           upper(regexp_replace(raw, '[[:punct:]]', '', 'g')) AS letters
    FROM raw
    """,
)
def name_cleaner_variants(t):
    raw = F.concat(F.lit("  "), page_title(), F.lit("   LLC.  INC. "))
    return t.pages.select(
        "page_id",
        strings.undot_company_form(raw).alias("undotted"),
        strings.squeeze_upper(raw).alias("squeezed"),
        strings.letters_upper(raw).alias("letters"),
    )


@query(
    "STR-04",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'Missing' ELSE event_type END AS label,
           CASE WHEN event_type <> 'view' THEN event_type END AS no_view
    FROM events
    """,
)
def blank_recode(t):
    kind = F.col("event_type")
    blanked = F.when(kind == "error", F.lit("  ")).otherwise(kind)
    return t.events.select(
        "event_id",
        strings.blank_to(blanked, "Missing").alias("label"),
        strings.none_text_to_null(kind, ["view"]).alias("no_view"),
    )


@query(
    "STR-05",
    """
    SELECT p_partkey,
           split_part(p_name, ' ', 1) || ' ' || CASE WHEN p_size > 25 THEN p_brand ELSE '' END || ' ' || split_part(p_name, ' ', 2) AS whole
    FROM part
    """,
)
def joined_person_names(t):
    middle = F.when(F.col("p_size") > 25, F.col("p_brand"))
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", strings.join_names(words[0], middle, words[1]).alias("whole"))


@query(
    "STR-06 STR-07 STR-08",
    """
    SELECT c_custkey,
      c_name || ', ' || n_name || ' ' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END || ' '
        || CASE WHEN c_nationkey - 10 < 0 THEN '' ELSE (c_nationkey - 10)::VARCHAR END AS address,
      c_name || ' ' || n_name || ' ' || CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS strict,
      lower(c_name || n_name) AS address_id
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def addresses(t):
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return df.select(
        "c_custkey",
        strings.full_address(
            strings.address_piece(F.col("c_name"), "string"),
            strings.address_piece(F.col("n_name"), "string"),
            strings.address_piece(segment, "string"),
            strings.address_piece(F.col("c_nationkey") - 10, "int"),
        ).alias("address"),
        strings.strict_address(F.col("c_name"), F.col("n_name"), segment).alias("strict"),
        strings.address_id(F.col("c_name"), F.col("n_name")).alias("address_id"),
    )


@query(
    "STR-09",
    """
    SELECT o_orderkey, o_totalprice AS from_text, o_totalprice AS from_number, NULL::DOUBLE AS from_junk FROM orders
    """,
)
def money_values(t):
    text = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return t.orders.select(
        "o_orderkey",
        strings.money(text).alias("from_text"),
        strings.money(F.col("o_totalprice"), "double").alias("from_number"),
        strings.money(F.col("o_orderpriority")).alias("from_junk"),
    )


@query(
    "STR-10 STR-11 STR-12 STR-16",
    r"""
    SELECT p_partkey, 'k' || p_partkey::VARCHAR AS head, p_brand || '_' || p_size::VARCHAR AS tail,
           regexp_replace(p_size::VARCHAR || '-20.' || p_type, '\..*', '') AS code,
           CASE WHEN length(p_size::VARCHAR) >= 2 THEN p_size::VARCHAR ELSE lpad(p_size::VARCHAR, 2, '0') END AS padded,
           replace(p_brand, 'Brand#', '') AS brand_number,
           replace('a-' || p_type || '-b', '-', '') AS undashed,
           p_type || '_' || p_size::VARCHAR AS composite
    FROM part
    """,
)
def code_parts(t):
    joined = F.concat(F.lit("k"), F.col("p_partkey"), F.lit("_"), F.col("p_brand"), F.lit("_"), F.col("p_size"))
    head, tail = strings.split_once(joined)
    return t.part.select(
        "p_partkey",
        head.alias("head"),
        tail.alias("tail"),
        strings.before_dot(F.concat(F.col("p_size").cast("string"), F.lit("-20."), F.col("p_type"))).alias("code"),
        strings.zero_pad(F.col("p_size")).alias("padded"),
        strings.strip_prefix(F.col("p_brand"), "Brand#").alias("brand_number"),
        strings.strip_dashes(F.concat(F.lit("a-"), F.col("p_type"), F.lit("-b"))).alias("undashed"),
        strings.composite_id(F.col("p_type"), F.col("p_size")).alias("composite"),
    )


@query(
    "STR-12",
    r"SELECT doc_id, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM documents",
)
def texts_without_breaks(t):
    return t.documents.select("doc_id", strings.strip_breaks(F.col("text")).alias("text"))


@query(
    "STR-13",
    r"""
    SELECT p_partkey, 'acs_' || p_name || '_' || regexp_replace(p_type || ' (' || p_brand || ')  x', '\s+|\(|\)', '_', 'g') AS readable
    FROM part
    """,
)
def readable_names(t):
    label = F.concat(F.lit("Estimate!!Total!!"), F.col("p_name"))
    concept = F.concat(F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(")  x"))
    return t.part.select("p_partkey", strings.readable_name(label, concept).alias("readable"))


@query(
    "STR-14",
    r"""
    WITH lists AS (
      SELECT l_orderkey AS id, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts,
             list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_returnflag <> 'R') AS supps
      FROM lineitem GROUP BY 1)
    SELECT id, unnest(parts) AS opponent, unnest(supps) AS state FROM lists WHERE len(parts) = len(supps)
    """,
)
def zipped_lists(t):
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    cell = F.struct(*order, F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("s"))
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    text = lists.select(
        "id",
        F.array_join(F.transform("c", lambda x: x["l_partkey"].cast("string")), "\r").alias("opponents"),
        F.array_join(F.transform("c", lambda x: x["s"].cast("string")), ",").alias("states"),
    ).where("states <> ''")
    return shapes.zip_split(text, {"opponents": "\r", "states": ","}, ["opponent", "state"])


@query(
    "STR-15",
    """
    SELECT event_id,
      CASE WHEN event_type = 'click' THEN event_type WHEN value > 20 THEN 'big' WHEN user_id % 3 = 0 THEN 'third' END AS party,
      CASE WHEN event_type = 'click' THEN 'kind' WHEN value > 20 THEN 'value' WHEN user_id % 3 = 0 THEN 'user' ELSE 'Missing all' END AS party_source
    FROM events
    """,
)
def first_present_source(t):
    value, label = strings.first_present(
        [
            (F.when(F.col("event_type") == "click", F.col("event_type")), "kind"),
            (F.when(F.col("value") > 20, F.lit("big")), "value"),
            (F.when(F.col("user_id") % 3 == 0, F.lit("third")), "user"),
        ],
        "Missing all",
    )
    return t.events.select("event_id", value.alias("party"), label.alias("party_source"))


@query(
    "STR-17 BL-05",
    """
    SELECT doc_id, contains(text, 'the ') AS has_word, regexp_matches(text, '[0-9]{3}') AS has_digits,
           length(text)::INTEGER AS n, (length(text) > 1000)::INTEGER AS is_long
    FROM documents
    """,
)
def text_tests(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        text.contains("the ").alias("has_word"),
        text.rlike("[0-9]{3}").alias("has_digits"),
        F.length(text).alias("n"),
        flags.indicator(F.length(text) > 1000).alias("is_long"),
    )


@query(
    "STR-18",
    """
    SELECT event_id, CASE WHEN event_type IN ('view','click') AND value > 10 THEN 'RF: deep'
       WHEN event_type IN ('view','click') THEN 'RF: shallow' WHEN event_type = 'error' THEN 'Lasso'
       WHEN event_type = 'signup' THEN 'GB: deep' ELSE 'DT: deep' END AS model_label
    FROM events
    """,
)
def model_labels(t):
    kind = F.col("event_type")
    code = (
        F.when(kind.isin("view", "click") & (F.col("value") > 10), F.lit("random_forest_100020"))
        .when(kind.isin("view", "click"), F.lit("random_forest_10020"))
        .when(kind == "error", F.lit("logit_l1_lowerpen"))
        .when(kind == "signup", F.lit("gb_deep"))
        .otherwise(F.lit("dt_deep"))
    )
    label = strings.label_by_pattern(code, strings.MODEL_LABELS, strings.MODEL_DEFAULT)
    return t.events.select("event_id", label.alias("model_label"))


@query(
    "DT-01 DT-02",
    """
    SELECT o_orderkey, o_orderdate::DATE AS from_slash, o_orderdate::DATE AS from_long, o_orderdate::DATE AS from_compact,
           o_orderdate::DATE AS from_head, NULL::DATE AS from_junk
    FROM orders
    """,
    days="from_slash from_long from_compact from_head from_junk",
)
def parsed_dates(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        dates.parse_date(F.date_format(d, "M/d/yyyy"), dates.LONG_DATE, dates.SLASH_DATE).alias("from_slash"),
        dates.parse_date(F.date_format(d, "MMMM d, yyyy"), dates.LONG_DATE).alias("from_long"),
        dates.parse_date(F.upper(F.date_format(d, "ddMMMyyyy")), dates.COMPACT_DATE).alias("from_compact"),
        dates.leading_date(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 00:00:00.000000"))).alias("from_head"),
        dates.parse_date(F.col("o_orderpriority"), dates.SLASH_DATE, dates.ISO_DATE).alias("from_junk"),
    )


@query(
    "DT-03 DT-05 DT-06",
    """
    SELECT event_id, year(ts)::INTEGER AS y, date_trunc('month', ts)::DATE AS month, 'MAR' AS quarter_end,
           ts::DATE AS day, (ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-20')::INTEGER AS in_range, strftime(ts, '%Y-%m-%d %H:%M:%S') AS wall_time
    FROM events
    """,
    days="month day",
)
def date_parts(t):
    ts = F.col("ts")
    day = ts.cast("date")
    return t.events.select(
        "event_id",
        F.year(ts).alias("y"),
        dates.month_floor(ts).alias("month"),
        dates.quarter_label(ts).alias("quarter_end"),
        day.alias("day"),
        dates.in_range_flag(day, F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")).alias("in_range"),
        F.date_format(dates.drop_zone(ts.cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("wall_time"),
    )


@query(
    "DT-04 AG-08",
    """
    WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS d FROM orders),
    m AS (SELECT d FROM d WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1)
    SELECT o_orderkey, (coalesce(d.d, m.d) - DATE '0001-01-01') + 1 AS day_number FROM d, m
    """,
)
def ordinal_dates(t):
    day = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date"))
    return shapes.ordinal_with_mode(t.orders.select("o_orderkey", day.alias("d")), "d", "day_number").select(
        "o_orderkey", "day_number"
    )


@query(
    "NUM-01 NUM-02 NUM-03",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS guarded,
      CASE WHEN l_discount - 0.05 >= 0 THEN l_quantity END AS no_sentinel,
      CASE WHEN l_tax <> 0 THEN l_tax END AS no_zero,
      abs(l_quantity - 25) AS distance, round_even(l_quantity / 2, 0) AS half
    FROM lineitem
    """,
)
def guarded_numbers(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        flags.ratio(F.col("l_tax"), F.col("l_discount")).alias("guarded"),
        F.when(flags.sentinel_to_null(F.col("l_discount") - 0.05).isNotNull(), F.col("l_quantity")).alias("no_sentinel"),
        flags.zero_to_null(F.col("l_tax")).alias("no_zero"),
        F.abs(F.col("l_quantity") - 25).alias("distance"),
        flags.half_even(F.col("l_quantity") / 2).alias("half"),
    )


@query(
    "BL-01 DT-02",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_returnflag = 'R', false) AS any_finding,
      l_returnflag = 'R' AND l_shipdate >= s AS finding_after_start,
      l_returnflag = 'R' AND l_shipdate < s AS finding_before_start,
      l_returnflag = 'R' AND l_shipdate >= s AND l_shipdate <= e AS finding_in_window,
      l_returnflag = 'R' AND l_shipdate >= s AND l_shipdate <= e AND l_quantity > 25 AS violation_in_window,
      l_returnflag = 'R' AND l_shipdate >= s AND l_shipdate <= e AND (l_quantity > 25 OR l_tax > 0.04 OR l_discount <> 0) AS any_violation_in_window
    FROM lineitem JOIN (SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS s, o_orderdate + INTERVAL 75 DAY AS e FROM orders)
      ON l_orderkey = o_orderkey
    """,
)
def window_outcomes(t):
    orders = t.orders.select(
        "o_orderkey",
        (F.col("o_orderdate") + F.expr("interval 30 day")).alias("s"),
        (F.col("o_orderdate") + F.expr("interval 75 day")).alias("e"),
    )
    df = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = flags.window_outcomes(
        F.col("l_returnflag") == "R", F.col("l_shipdate"), F.col("s"), F.col("e"),
        F.greatest(F.col("l_quantity") - 25, F.lit(0.0)), (F.col("l_tax") - 0.04, F.col("l_discount")),
    )
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in out.items()])


@query(
    "BL-02",
    """
    SELECT o_orderkey, CASE WHEN a AND b THEN 'Both A and B' WHEN a AND NOT b THEN 'A; not B' WHEN NOT a AND b THEN 'B; not A'
      ELSE 'Neither A nor B' END AS category
    FROM (SELECT o_orderkey, o_orderstatus = 'F' AS a,
          CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice > 200000 END AS b FROM orders)
    """,
)
def two_source_categories(t):
    a = F.col("o_orderstatus") == "F"
    b = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") > 200000)
    return t.orders.select("o_orderkey", flags.two_source_category(a, b, "A", "B").alias("category"))


@query(
    "BL-03 BL-04",
    """
    SELECT event_id, CASE WHEN abs(a) < 0.1 AND abs(b) < 0.1 THEN 'Small both' WHEN a > 0 AND b > 0 THEN 'Higher risk both'
       WHEN a < 0 AND b < 0 THEN 'Lower risk both' WHEN a > 0 AND b < 0 THEN 'Higher risk A'
       WHEN a < 0 AND b > 0 THEN 'Higher risk B' END AS effect,
       CASE WHEN p AND q THEN 'TP' WHEN p THEN 'FP' WHEN q THEN 'FN' ELSE 'TN' END AS hit,
       CASE WHEN p THEN 'predicted positive' ELSE 'predicted negative' END AS side
    FROM (SELECT event_id, value / 10 - 1 AS a, (user_id % 5 - 2)::DOUBLE / 10 AS b, value > 12 AS p, event_type = 'error' AS q FROM events)
    """,
)
def effect_and_hit_categories(t):
    a = F.col("value") / 10 - 1
    b = (F.col("user_id") % 5 - 2).cast("double") / 10
    hit = flags.hit_category(F.col("value") > 12, F.col("event_type") == "error")
    return t.events.select(
        "event_id",
        flags.coefficient_category(a, b, "A", "B").alias("effect"),
        hit.alias("hit"),
        flags.predicted_side(hit).alias("side"),
    )
