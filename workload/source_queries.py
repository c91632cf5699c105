"""Writing the driver tables in the study's layouts and reading them back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.operators import schema
from harrow.session import checkpoint_folder
from harrow.sources import files, sinks
from workload.model_queries import INPUTS, labelled
from workload.registry import query


def shared_path(t) -> str:
    """A fresh place in the folder all executors share."""
    return f"{checkpoint_folder(t.spark)}/tables-{uuid.uuid4().hex}"


@query(
    "SRC-01 SNK-01 SCH-13",
    "SELECT doc_id::DOUBLE AS doc_id, text, lang, n_chars::DOUBLE AS n_chars FROM documents",
)
def csv_round_trip(t):
    path = shared_path(t)
    texts = t.documents.select("doc_id", "text", "lang", "n_chars")  # texts hold quotes and line breaks
    sinks.write_table(texts, path, "csv")
    words = {"string": "Char", "date": "Date"}
    dictionary = [(name, words.get(kind, "Numeric")) for name, kind in texts.dtypes]
    return files.read_delimited(t.spark, path, schema.schema_from_dictionary(dictionary), split=True)


@query(
    "SRC-02 STR-11",
    "SELECT p_partkey, lpad(p_size::VARCHAR, 4, '0') AS code, p_retailprice, NULL::BIGINT AS junk FROM part",
)
def typed_overrides(t):
    path = shared_path(t)
    coded = t.part.select("p_partkey", F.lpad(F.col("p_size").cast("string"), 4, "0").alias("code"), "p_retailprice", F.col("p_name").alias("junk"))
    sinks.write_table(coded, path, "csv")
    return files.read_with_types(t.spark, path, {"p_partkey": "bigint", "p_retailprice": "double", "junk": "bigint"})


@query("SRC-03 SNK-03 PL-01 SCH-04", "SELECT o_orderkey, o_totalprice, year(o_orderdate)::INTEGER AS year FROM orders")
def period_files(t):
    """Yearly files whose headers differ in order and in names, to one table."""
    path = shared_path(t)
    named = t.orders.withColumn("file", F.year("o_orderdate"))
    headers = (
        ("early", "file < 1998", (F.col("o_orderkey"), F.col("o_totalprice"))),
        ("early", "file = 1998", (F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderkey"))),
        ("late", "file > 1998", (F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("CASE_NO"))),
    )
    for folder, years, columns in headers:
        written = named.where(years).select(*columns, "file").write.partitionBy("file").mode("append")
        written.option("header", True).csv(f"{path}/{folder}")
    years = "(?:19|20)[0-9]{2}"
    periods = {
        "early": files.read_periods(t.spark, f"{path}/early/file=*", "o_orderkey bigint, o_totalprice double", pattern=years),
        "late": files.read_periods(t.spark, f"{path}/late/file=*", "CASE_NO bigint, price double", pattern=years),
    }
    renamed = schema.rename_periods(periods, {"CASE_NO": "o_orderkey"}, {"late": {"price": "o_totalprice"}})
    return schema.stack_common(list(renamed.values()))


@query(
    "SRC-03",
    """
    SELECT o_orderkey, o_custkey, year(o_orderdate)::INTEGER AS "YEAR", upper(strftime(o_orderdate, '%b')) AS "QUARTER" FROM orders
    """,
)
def quarter_files(t):
    path = shared_path(t)
    name = F.concat(F.lit("FACT_"), F.upper(F.date_format("o_orderdate", "MMM")), F.year("o_orderdate").cast("string"))
    t.orders.select("o_custkey", "o_orderkey", name.alias("file")).write.partitionBy("file").option("header", True).csv(path)
    return files.read_quarters(t.spark, f"{path}/file=*", "o_orderkey bigint, o_custkey bigint")


@query("SRC-04 SCH-06", "SELECT o_orderkey, 'sheet=' || o_orderstatus AS sheet FROM orders")
def stacked_sheets(t):
    path = shared_path(t)
    rows = t.orders.select(F.col("o_custkey").alias("Unnamed: 0"), "o_orderkey", F.col("o_orderstatus").alias("sheet"))
    rows.write.partitionBy("sheet").option("header", True).csv(path)
    return files.read_sheets(t.spark, f"{path}/sheet=*", "`Unnamed: 0` bigint, o_orderkey bigint")


@query(
    "SNK-02",
    "SELECT o_custkey, count(*) AS n, 1::BIGINT AS builds FROM orders GROUP BY 1",
)
def reused_stage(t):
    path = shared_path(t)
    built = []

    def build():
        built.append(1)
        return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))

    sinks.stage(t.spark, path, build)
    again = sinks.stage(t.spark, path, build)
    return again.withColumn("builds", F.lit(len(built)).cast("long"))


@query("SNK-03", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def one_output_per_state(t):
    path = shared_path(t)
    sinks.write_by_key(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), path, "s_nationkey")
    return sinks.read_by_key(t.spark, path)


@query(
    "SNK-05",
    """
    SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 200000 END, false) AS matched FROM orders
    """,
)
def matched_and_unmatched_tables(t):
    rule = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 200000)
    paths = sinks.write_sides(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), rule, shared_path(t))
    parts = [
        t.spark.read.parquet(p).select("o_orderkey", F.lit(side == "matched").alias("matched")) for side, p in paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query("SNK-04 ML-10", "SELECT count(*) AS n, 0::BIGINT AS n_changed, 1.0::DOUBLE AS importance FROM documents JOIN labels USING (doc_id)")
def reloaded_model_agrees(t):
    """A model read back predicts what the fitted one does; a tree's importances add up to 1."""
    from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier

    from harrow.operators.models import importances, predictions

    df = labelled(t).select("doc_id", "features", "label")
    path = shared_path(t)
    fitted = DecisionTreeClassifier(maxDepth=5, seed=0).fit(df)
    sinks.save_model(fitted, path)
    again = sinks.load_model(DecisionTreeClassificationModel, path)
    a = predictions(fitted, "fitted", df, ["doc_id"]).select("doc_id", F.col("predicted_cont_true").alias("a"))
    b = predictions(again, "reloaded", df, ["doc_id"]).select("doc_id", F.col("predicted_cont_true").alias("b"))
    same = a.join(b, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"))
    whole = importances(again, "reloaded", INPUTS, df).agg(F.round(F.sum("value"), 9).alias("importance"))
    return same.crossJoin(whole)  # one row each


@query("SNK-04 ML-10")
def reloaded_model(t):
    from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier

    from harrow.operators.models import importances

    df = labelled(t).select("features", "label").cache()
    path = shared_path(t)
    sinks.save_model(DecisionTreeClassifier(maxDepth=5, seed=0).fit(df), path)
    return importances(sinks.load_model(DecisionTreeClassificationModel, path), "reloaded", INPUTS, df)
