"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.operators import supervised as M
from flowscope.operators.report import class_guard
from flowscope.plans import bindings as B
from flowscope.plans.registry import query
from flowscope.session import scratch_path
from flowscope.sources import flows as R
from flowscope.sources import sinks as W


@query(
    "union_scan",
    """SELECT kind, count(*) AS n, round(sum(acctbal), 2) AS balance, count(segment) AS segments FROM (
         SELECT 'customer' AS kind, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
         UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY kind""",
)
def union_scan(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")
    )
    s = B.table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("kind"))
    return (
        R.union_tables([c, s])
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("acctbal"), 2).alias("balance"), F.count("segment").alias("segments"))
    )


@query(
    "multi_file_scan",
    """SELECT count(*) AS n, count(o_orderkey) AS orders, count(event_id) AS events FROM (
         SELECT o_orderkey, NULL AS event_id FROM orders UNION ALL SELECT NULL, event_id FROM events)""",
)
def multi_file_scan(spark, sf_dir):
    df = R.load_flows(spark, sf_dir, ["orders.parquet", "events.parquet"])
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("orders"), F.count("event_id").alias("events")
    )


@query(
    "labelled_file_scan",
    """SELECT 'orders' AS "Label", count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events
       UNION ALL SELECT 'embeddings', count(*) FROM embeddings""",
)
def labelled_file_scan(spark, sf_dir):
    schema = T.StructType([T.StructField("o_orderkey", T.LongType())])
    df = R.labelled_scan(spark, sf_dir, "{orders,events,embeddings}*.parquet", schema)
    return df.groupBy("Label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "csv_scan",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount
       FROM lineitem GROUP BY l_returnflag""",
)
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    source = B.table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_linenumber", "l_returnflag")
    source.write.option("header", "true").csv(path)
    df = R.scan_csv(spark, path, R.integers_as_double(source.schema))
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
    )


@query(
    "indexed_csv",
    """SELECT event_id AS row_idx, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) + 0.0 AS value,
              round((user_id - avg(user_id) OVER ()) / stddev_pop(user_id) OVER (), 6) + 0.0 AS user_id,
              CAST(event_type = 'error' AS INTEGER) AS y FROM events""",
)
def indexed_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    source = B.events(spark, sf_dir).select("event_id", F.col("user_id").cast("double").alias("user_id"), "value", "Label")
    source.write.option("header", "true").csv(path)
    df, _ = R.load_indexed_csv(spark, path, source.schema, "event_id")
    return df.select(
        "row_idx", (F.round("value", 6) + 0.0).alias("value"), (F.round("user_id", 6) + 0.0).alias("user_id"), "y"
    )


@query(
    "present_columns",
    "SELECT round(avg(l_quantity), 6) AS mean_length, count(*) AS n FROM lineitem",
)
def present_columns(spark, sf_dir):
    df = R.select_present(B.table(spark, sf_dir, "lineitem"), ["Source IP", "l_quantity", "l_discount", "Destination Port"])
    length = R.first_present(df, ["Packet Length", "l_quantity", "l_discount"])
    return df.agg(F.round(F.avg(length), 6).alias("mean_length"), F.count(F.lit(1)).alias("n"))


@query(
    "prefix_rows",
    "SELECT event_id, event_type, value FROM events WHERE event_id < 2000",
)
def prefix_rows(spark, sf_dir):
    return R.file_prefix(spark, f"{sf_dir}/events.parquet", 2000).select("event_id", "event_type", "value")


@query(
    "attach_side_column",
    """SELECT d.source, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS quality, CAST(sum(l.toxic) AS BIGINT) AS toxic
       FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source""",
)
def attach_side_column(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    return (
        R.attach_by_index(docs, B.table(spark, sf_dir, "labels"), "doc_id")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    )


@query(
    "saved_model",
    """SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) + 0.0 AS value_scaled,
              round((user_id - avg(user_id) OVER ()) / stddev_samp(user_id) OVER (), 6) + 0.0 AS user_scaled FROM events""",
)
def saved_model(spark, sf_dir):
    """A fitted scaler pipeline written, read back and applied to all events."""
    df = B.events(spark, sf_dir).select("event_id", "value", "user_id")
    stages = [VectorAssembler(inputCols=["value", "user_id"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
    path = scratch_path(spark, "model")
    M.save_model(Pipeline(stages=stages).fit(df), path)
    scaled = M.load_model(path).transform(df).withColumn("x", vector_to_array("scaled"))
    return scaled.select("event_id", (F.round(F.col("x")[0], 6) + 0.0).alias("value_scaled"), (F.round(F.col("x")[1], 6) + 0.0).alias("user_scaled"))


@query(
    "prepared_cache",
    """SELECT event_type, count(*) AS n, round(avg(value / 500), 6) AS mean_share FROM events GROUP BY event_type""",
)
def prepared_cache(spark, sf_dir):
    path = scratch_path(spark, "prepared")
    build = lambda: B.events(spark, sf_dir).select("event_id", "event_type", (F.col("value") / 500).alias("share"))
    R.materialise_or_load(spark, path, build)
    again = R.materialise_or_load(spark, path, build)
    return again.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("mean_share"))


@query(
    "cluster_side_export",
    """SELECT CASE WHEN event_type = 'click' THEN 'positive' ELSE 'complement' END AS side, count(*) AS n,
              round(sum(value), 2) AS value FROM events GROUP BY 1""",
)
def cluster_side_export(spark, sf_dir):
    path = scratch_path(spark, "sides")
    W.export_cluster_sides(B.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "click", path)
    return spark.read.parquet(path).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(
    "misclassified_export",
    """SELECT CASE WHEN event_type = 'error' THEN 'FN' ELSE 'FP' END AS kind, count(*) AS n,
              CAST(sum(event_id) AS BIGINT) AS ids FROM events
       WHERE (event_type = 'error') <> (value > 40) GROUP BY 1""",
)
def misclassified_export(spark, sf_dir):
    path = scratch_path(spark, "missed")
    df = B.events(spark, sf_dir).select("event_id", "value", "Label")
    W.export_misclassified(df, F.col("Label") == "DDoS", F.col("value") > 40, path)
    back = spark.read.schema("event_id bigint, value double, Label string, kind string").option("header", "true").csv(path)
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "run_summary",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
       SELECT event_type AS cluster, 'trained' AS status, n AS rows FROM c""",
)
def run_summary(spark, sf_dir):
    df = B.events(spark, sf_dir).withColumn("parity", (F.col("event_id") % 2).cast("string"))
    guard = class_guard(df, "event_type", "parity")
    path = scratch_path(spark, "summary")
    W.write_summary(W.run_summary("forest", guard), path)
    shape = "model string, clusters array<struct<cluster: string, status: string, rows: bigint>>"
    docs = spark.read.schema("model string, run_at timestamp, summary string").json(path)
    return docs.select(F.inline(F.from_json("summary", shape)["clusters"])).select("cluster", "status", "rows")
