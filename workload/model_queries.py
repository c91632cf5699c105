"""Feature preparation, classifiers and their review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import flags, strings
from harrow.operators import aggregates, features, groups, models
from harrow.operators.joins import complete_counts
from harrow.session import cut_lineage
from workload.registry import query


@query(
    "FE-01",
    """
    WITH v AS (SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type || (floor(value))::INTEGER::VARCHAR END, 'missing') AS level, user_id FROM events),
    c AS (SELECT level, count(*) AS n FROM v GROUP BY 1)
    SELECT event_id, CASE WHEN n >= floor((SELECT count(DISTINCT user_id) FROM v) * 0.5) THEN v.level ELSE 'OTHER' END AS level FROM v JOIN c ON c.level = v.level
    """,
)
def collapsed_levels(t):
    level = F.when(F.col("event_type") != "view", F.concat("event_type", F.floor("value").cast("string")))
    v = t.events.select("event_id", level.alias("level"), "user_id")
    return features.collapse_rare(v, "level", "user_id", 0.5).select("event_id", "level")


@query(
    "FE-02",
    """
    WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(o_custkey::VARCHAR || ':42'), o_custkey) <= floor((SELECT count(DISTINCT o_custkey) FROM orders) * 0.8) AS is_train
      FROM (SELECT DISTINCT o_custkey FROM orders))
    SELECT o_orderkey, is_train FROM orders JOIN g USING (o_custkey)
    """,
)
def group_split(t):
    return features.split_by_group(t.orders, "o_custkey").select("o_orderkey", "is_train")


@query(
    "FE-03",
    """
    SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR || ':42'), 1, 8))::BIGINT % 1000000 < 800000 AS is_train FROM orders
    """,
)
def row_split(t):
    return features.split_rows(t.orders, "o_orderkey").select("o_orderkey", "is_train")


@query(
    "FE-04 FE-05",
    """
    WITH v AS (SELECT o_orderkey, year(o_orderdate) < 2000 AS is_train, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)
    SELECT o_orderkey, is_train, round(coalesce(price, (SELECT avg(price) FROM v WHERE is_train)), 4) AS price, coalesce(priority, 'missing_value') AS priority FROM v
    """,
)
def imputed_means(t):
    v = t.orders.select(
        "o_orderkey", (F.year("o_orderdate") < 2000).alias("is_train"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"),
    )
    train, test = features.impute_mean(v.where("is_train"), [v.where("NOT is_train")], ["price"])
    return features.impute_constant(train.unionByName(test), ["priority"]).withColumn("price", F.round("price", 4))


@query(
    "FE-06 AG-08",
    """
    WITH v AS (SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_size END AS size, CASE WHEN p_size > 10 THEN p_brand END AS brand FROM part)
    SELECT p_partkey, coalesce(size, (SELECT size FROM v WHERE size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, size LIMIT 1)) AS size,
      coalesce(brand, (SELECT brand FROM v WHERE brand IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, brand LIMIT 1)) AS brand FROM v
    """,
)
def imputed_modes(t):
    v = t.part.select(
        "p_partkey", F.when(F.col("p_type") != "PROMO", F.col("p_size")).alias("size"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand")
    )
    return features.impute_mode(v, ["size", "brand"])


@query(
    "FE-07",
    """
    SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS "o_orderstatus_F", (o_orderstatus = 'O')::INTEGER AS "o_orderstatus_O",
      (o_orderstatus = 'P')::INTEGER AS "o_orderstatus_P" FROM orders
    """,
)
def dummy_columns(t):
    df = t.orders.select("o_orderkey", "o_orderstatus")
    return features.dummies(df, {"o_orderstatus": features.levels_of(df, "o_orderstatus")})


@query(
    "FE-08",
    """
    WITH l AS (SELECT DISTINCT o_orderpriority AS level FROM orders WHERE year(o_orderdate) < 2000 AND o_orderpriority <> '5-LOW')
    SELECT o_orderkey, string_agg(CASE WHEN o_orderpriority = level THEN '1.0' ELSE '0.0' END, ',' ORDER BY level) AS hot
    FROM orders, l WHERE year(o_orderdate) >= 2000 GROUP BY o_orderkey
    """,
)
def one_hot_levels(t):
    old, new = t.orders.where("year(o_orderdate) < 2000 AND o_orderpriority <> '5-LOW'"), t.orders.where("year(o_orderdate) >= 2000")
    encoder = features.one_hot(old, ["o_orderpriority"])
    from pyspark.ml.functions import vector_to_array

    return encoder.transform(new).select("o_orderkey", F.array_join(vector_to_array("o_orderpriority_hot").cast("array<string>"), ",").alias("hot"))


@query(
    "FE-09 FE-12 SCH-07",
    """
    SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, 'o_totalprice,o_orderstatus' AS common FROM orders
    """,
)
def aligned_columns(t):
    train = t.orders.where("o_orderdate < '1999-01-01'").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.lit(None).cast("string").alias("empty"), "o_orderpriority"
    )
    test = t.orders.where("o_orderdate >= '1999-01-01'").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    train = features.drop_unusable(train)
    a, b = features.align(train, test, ["o_orderkey"])
    both = a.unionByName(b)
    return both.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn(
        "common", F.lit(",".join(both.columns))
    )


@query(
    "FE-10",
    """
    WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM labels WHERE toxic = 1),
    d AS (SELECT range AS draw, ('0x' || substr(md5(range::VARCHAR || ':91988'), 1, 8))::BIGINT % (SELECT count(*) FROM s) + 1 AS i
      FROM range(1, (SELECT count(*) FROM labels WHERE toxic <> 1) + 1))
    SELECT doc_id, 0::BIGINT AS draw, 0 AS toxic FROM labels WHERE toxic <> 1 UNION ALL SELECT doc_id, draw, 1 FROM d JOIN s USING (i)
    """,
)
def upsampled_minority(t):
    return features.upsample(t.labels.select("doc_id", "toxic"), "toxic", 1, "doc_id")


@query("FE-11", "SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS label FROM orders WHERE o_orderstatus <> 'P'")
def binary_labels(t):
    df = features.dummies(t.orders.select("o_orderkey", "o_orderstatus"), {"o_orderstatus": ["F", "O", "P"]})
    return features.binary_label(df, "o_orderstatus_F", "o_orderstatus_P").select("o_orderkey", "label")


INPUTS = ["n_chars", "n_lines", "n_digits", "n_words", "is_en", "is_fr", "is_de"]


def labelled(t):
    """Quality labels with plain measures of the whole text."""
    text = F.col("text")
    measures = {
        "n_lines": F.size(F.split(text, "\n")),
        "n_digits": F.length(F.regexp_replace(text, "[^0-9]", "")),
        "n_words": F.size(F.split(text, " ")),
        **{f"is_{v}": (F.col("lang") == v).cast("int") for v in ("en", "fr", "de")},
    }
    df = t.documents.join(t.labels, "doc_id").withColumns(measures)
    scaled = df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in INPUTS[:4]})
    narrow = features.assemble(scaled, INPUTS).select("doc_id", "source", "features", F.col("quality").alias("label"), "toxic")
    return cut_lineage(narrow)  # texts are measured once, however often a fit reads the rows


def train_and_test(t):
    """Upsampled training rows and untouched test rows, split by source."""
    split = features.split_by_group(labelled(t), "source")
    train = features.upsample(split.where("is_train").drop("is_train"), "label", 0, "doc_id")
    return train, split.where("NOT is_train").drop("is_train")


def estimate_named(t, *names):
    train, test = train_and_test(t)
    train = train.cache()
    chosen = models.estimators(train.count())
    return models.estimate({n: chosen[n] for n in names}, train, test, INPUTS, ["doc_id"])


@query("ML-01 ML-05 ML-06 ML-08 PL-09")
def tree_and_logit_predictions(t):
    return estimate_named(t, "dt_shallow", "dt_deep", "logit_l1_lowerpen", "logit_l2_lowerpen")["predictions"]


@query(
    "ML-01 ML-03 ML-05 ML-06 ML-08 PL-09",
    """
    WITH g AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':42'), source) <= floor((SELECT count(DISTINCT source) FROM documents JOIN labels USING (doc_id)) * 0.8) AS is_train
      FROM (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id))),
    t AS (SELECT count(*) AS n, sum(quality)::BIGINT AS n_actual FROM documents JOIN labels USING (doc_id) JOIN g USING (source) WHERE NOT is_train)
    SELECT model, n, n AS n_documents, n_actual, 0::BIGINT AS n_off_sums, 0::BIGINT AS n_off_sides, true AS scores_follow
    FROM t, (VALUES ('dt_shallow'), ('logit_l2_lowerpen'), ('gb_shallow')) AS m(model)
    """,
)
def prediction_checks(t):
    """What must hold of predictions exactly: every test row once, probabilities that add up, the likelier side, scores that follow."""
    found = estimate_named(t, "dt_shallow", "logit_l2_lowerpen", "gb_shallow")
    likelier = (F.col("predicted_cont_true") > F.col("predicted_cont_false")).cast("double")
    even = F.col("predicted_cont_true") == F.col("predicted_cont_false")
    checks = found["predictions"].groupBy("model").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"), F.sum("actual").cast("long").alias("n_actual"),
        F.count_if(F.abs(F.col("predicted_cont_true") + F.col("predicted_cont_false") - 1) > 1e-9).alias("n_off_sums"),
        F.count_if(~even & (F.col("predicted") != likelier)).alias("n_off_sides"),
    )
    cells = found["confusion"].groupBy("model").agg(
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("right"), F.sum("n").alias("all")
    )
    follow = found["evals"].join(cells, "model").select(
        "model", (F.abs(F.col("accuracy") - F.coalesce("right", F.lit(0)) / F.col("all")) < 1e-12).alias("scores_follow")
    )
    return checks.join(follow, "model")


@query("ML-02 ML-06")
def forest_scores(t):
    return estimate_named(t, "random_forest_10020")["evals"]


@query("ML-03 ML-06")
def boosting_scores(t):
    return estimate_named(t, "gb_shallow")["evals"]


@query("ML-04 ML-06")
def adaboost_scores(t):
    return estimate_named(t, "ada")["evals"]


@query("ML-05")
def cross_validated_logit(t):
    train, test = train_and_test(t)
    train = train.cache()
    fitted = models.cross_validated_logit(train, train.count())
    return models.scores(models.predictions(fitted.bestModel, "logit_cv", test))


@query(
    "ML-07",
    """
    WITH v AS (SELECT event_type AS model, (value > 10)::INTEGER AS p, (hour(ts) < 6)::INTEGER AS a FROM events)
    SELECT model, avg((p = a)::DOUBLE) AS accuracy, sum(p * a) / sum(p) AS precision, sum(p * a) / sum(a) AS recall, 2 * sum(p * a) / (sum(p) + sum(a)) AS f1 FROM v GROUP BY 1
    """,
)
def classification_scores(t):
    return models.scores(
        t.events.select(
            F.col("event_type").alias("model"), (F.col("value") > 10).cast("int").alias("predicted"), (F.hour("ts") < 6).cast("int").alias("actual")
        )
    )


@query("ML-10")
def feature_importances(t):
    return estimate_named(t, "dt_shallow", "logit_l1_lowerpen")["importances"]


@query("ML-10 FLT-10")
def nonzero_importances(t):
    return models.nonzero_counts(estimate_named(t, "dt_deep", "logit_l1_lowerpen")["importances"])


@query("ML-11 W-08 BL-03")
def compared_logits(t):
    df = labelled(t).select("features", "label", "toxic").cache()
    table = models.paired_logits(df, INPUTS, ("label", "toxic"))
    wide = aggregates.widen(table, ["coef_name"], "model", "value", ["label", "toxic"])
    ranks = groups.compare_ranks(table, "model", "coef_name", "value", ["label", "toxic"])
    ranks = ranks.withColumnsRenamed({"label": "rank_label", "toxic": "rank_toxic"})
    effect = flags.coefficient_category(F.col("label"), F.col("toxic"), "label", "toxic")
    return wide.withColumn("effect", effect).join(ranks, "coef_name")


@query(
    "ML-12",
    """
    WITH c AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'acs_' ELSE 'Acs_' END || p_name AS n, l_tax - 0.0399 AS v FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'
      UNION ALL SELECT p_brand, l_tax - 0.0399 FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (SELECT upper(n) AS coef_name_upper, round(avg(v), 9) AS value FROM c GROUP BY 1),
    r AS (SELECT *, starts_with(coef_name_upper, 'ACS') AS has_prefix, row_number() OVER (PARTITION BY starts_with(coef_name_upper, 'ACS') ORDER BY value DESC, coef_name_upper) AS place FROM m WHERE value > 0)
    SELECT coef_name_upper, value, has_prefix, place::INTEGER AS place FROM r WHERE place <= CASE WHEN has_prefix THEN 10 ELSE 20 END
    """,
)
def averaged_coefficients(t):
    df = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    spelled = F.when(F.col("l_linenumber") % 2 == 0, F.lit("acs_")).otherwise(F.lit("Acs_"))
    one = df.where("l_returnflag = 'R'").select(F.concat(spelled, "p_name").alias("coef_name"), (F.col("l_tax") - 0.0399).alias("value"))
    two = df.select(F.col("p_brand").alias("coef_name"), (F.col("l_tax") - 0.0399).alias("value"))
    out = models.average_by_name(one.unionByName(two), "acs")
    return out.withColumn("value", F.round("value", 9))


@query(
    "ML-13 PL-11",
    """
    WITH o AS (SELECT c_nationkey AS n, year(o_orderdate) AS y, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT n_nationkey AS n, range AS y, count(v)::DOUBLE AS x, coalesce(sum(v), 0) / 1000 AS v FROM nation, range(1995, 2002) LEFT JOIN o ON o.n = n_nationkey AND o.y = range GROUP BY ALL),
    d AS (SELECT n, x - avg(x) OVER (PARTITION BY n) - avg(x) OVER (PARTITION BY y) + avg(x) OVER () AS x, v - avg(v) OVER (PARTITION BY n) - avg(v) OVER (PARTITION BY y) + avg(v) OVER () AS v, y FROM p),
    s AS (SELECT count(*) AS c, count(DISTINCT n) AS u, count(DISTINCT y) AS p, sum(x * x) AS xx, sum(x * v) AS xy, sum(v * v) AS yy FROM d)
    SELECT round(xy / xx, 6) AS slope, round(sqrt((yy - xy / xx * xy) / (c - u - p) / xx), 6) AS std_error, c AS n FROM s
    """,
)
def two_way_panel(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    summed = df.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("x"), (F.sum("o_totalprice") / 1000).alias("v")
    )
    years = F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year")
    grid = t.nation.select(F.col("n_nationkey").alias("nation"), years)
    panel = complete_counts(summed, grid, ["nation", "year"], ["x", "v"])
    out = models.two_way_effects(panel, "nation", "year", "x", "v")
    return out.withColumns({"slope": F.round("slope", 6), "std_error": F.round("std_error", 6)})


def scored_events(t):
    return t.events.select(
        "event_id", F.col("event_type").alias("model"), (F.hour("ts") < 6).cast("int").alias("actual"),
        (F.col("value") / 100).alias("predicted_cont_true"),
    )


@query(
    "ML-14",
    """
    WITH v AS (SELECT event_type AS model, (hour(ts) < 6)::INTEGER AS actual, least(floor(value / 100 * 20), 19)::BIGINT AS bin FROM events),
    c AS (SELECT model, actual, bin, count(*) AS n FROM v GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY model, actual) * 20, 9) AS density FROM c
    """,
)
def score_histogram(t):
    return models.score_histogram(scored_events(t)).withColumn("density", F.round("density", 9))


@query(
    "ML-15",
    """
    WITH p AS (SELECT ntile(10) OVER (ORDER BY l_quantity, l_extendedprice) - 1 AS bin, l_quantity, l_extendedprice FROM lineitem)
    SELECT bin, sum(l_quantity::DECIMAL(18, 4))::DOUBLE / count(*) AS mean_x, sum(l_extendedprice::DECIMAL(18, 4))::DOUBLE / count(*) AS mean_y, count(*) AS n
    FROM p GROUP BY 1
    """,
)
def binned_trend(t):
    return models.binned_trend(t.lineitem, "l_quantity", "l_extendedprice")


@query(
    "ML-15",
    """
    WITH p AS (SELECT ntile(20) OVER (ORDER BY l_quantity, l_extendedprice) - 1 AS bin, l_quantity::DECIMAL(18, 4) AS x, l_extendedprice::DECIMAL(18, 4) AS y FROM lineitem),
    b AS (SELECT bin, count(*) AS n, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y, sum(x * x)::DOUBLE AS xx, sum(x * y)::DOUBLE AS xy, sum(x)::DOUBLE / count(*) AS center FROM p GROUP BY 1),
    f AS (SELECT a.bin AS bin, a.center, a.n AS own, b.n, b.x, b.y, b.xx, b.xy, abs(b.center - a.center) AS far,
      row_number() OVER (PARTITION BY a.bin ORDER BY abs(b.center - a.center), b.bin) AS place FROM b a, b),
    w AS (SELECT *, (1 - (far / (max(far) OVER (PARTITION BY bin) * 1.000001)) ** 3) ** 3 AS w FROM f WHERE place <= 8),
    s AS (SELECT bin, center, own, sum(w * n) AS s, sum(w * (x - n * center)) AS sx, sum(w * y) AS sy,
      sum(w * (xx - 2 * center * x + n * center * center)) AS sxx, sum(w * (xy - center * y)) AS sxy FROM w GROUP BY ALL)
    SELECT bin, round(center, 6) AS center, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 3) AS smooth, own AS n FROM s
    """,
)
def smoothed_trend(t):
    out = models.smoothed_trend(t.lineitem, "l_quantity", "l_extendedprice")
    return out.withColumns({"center": F.round("center", 6), "smooth": F.round("smooth", 3)})


@query(
    "PL-10 W-06 BL-04 AG-24 STR-18 FLT-10",
    """
    WITH v AS (SELECT event_id, event_type AS model, hour(ts) < 6 AS a, value / 100 AS s FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, event_id) <= round_even(0.05 * count(*) OVER (PARTITION BY model), 0) AS p FROM v),
    k AS (SELECT model, CASE WHEN p AND a THEN 'TP' WHEN p THEN 'FP' WHEN a THEN 'FN' ELSE 'TN' END AS category, count(*) AS n FROM r GROUP BY ALL)
    SELECT model, category, n, round(n / sum(n) OVER (PARTITION BY model) * 100, 9) AS percent,
      CASE WHEN category IN ('TP', 'FP') THEN 'predicted positive' ELSE 'predicted negative' END AS side FROM k
    """,
)
def top_cut_review(t):
    from harrow.plans.review import review_top_cut

    out = review_top_cut(scored_events(t), "event_id")
    return out.withColumn("percent", F.round("percent", 9))
