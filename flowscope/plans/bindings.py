"""The driver's tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.functions.columns import ATTACK, BENIGN

# One identity for a lineitem row: all columns, since no shorter key is unique.
LINE_IDS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
FLOW_IDS = ("order_id", "part_id", "supp_id", "Protocol", "Flow Duration", "Flow Bytes/s", "Flow IAT Mean", "Active Mean")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a label: errors are the attack."""
    label = F.when(F.col("event_type") == "error", ATTACK).otherwise(BENIGN)
    return table(spark, sf_dir, "events").withColumn("Label", label)


def flows(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """lineitem as flow records: raw columns, an attack family and the collapsed label.

    ``source`` may bring lineitem with a ``row_idx``, which is kept.
    """
    d = F.col
    lines = table(spark, sf_dir, "lineitem") if source is None else source
    extra = [d("row_idx")] if "row_idx" in lines.columns else []
    return lines.select(
        *extra,
        d("l_orderkey").alias("order_id"),
        d("l_partkey").alias("part_id"),
        d("l_suppkey").alias("supp_id"),
        d("l_linenumber").cast("bigint").alias("Protocol"),
        d("l_quantity").alias("Flow Duration"),
        d("l_extendedprice").alias("Flow Bytes/s"),
        d("l_quantity").alias("Flow Packets/s"),
        (d("l_linenumber") % 2).cast("bigint").alias("Fwd PSH Flags"),
        (d("l_linenumber") % 3).cast("bigint").alias("Bwd PSH Flags"),
        d("l_quantity").cast("bigint").alias("Total Fwd Packets"),
        d("l_linenumber").cast("bigint").alias("Total Backward Packets"),
        d("l_discount").alias("Flow IAT Mean"),
        d("l_tax").alias("Active Mean"),
        d("l_discount").alias("Idle Mean"),
        F.when(d("l_returnflag") == "N", BENIGN).when(d("l_returnflag") == "A", "Syn").otherwise("UDP").alias("Family"),
        F.when(d("l_returnflag") == "N", BENIGN).otherwise(ATTACK).alias("Label"),
        d("l_linestatus").alias("Status"),
    )


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a connection log: counters, one-hot protocol and state, label."""
    d = F.col
    price = d("l_extendedprice")
    attack = ((d("l_returnflag") != "N") & (d("l_quantity") > 5)) | (price > 60000)
    states = {"S0": "R", "OTH": "A", "SF": "N"}
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        d("l_quantity").alias("duration"),
        price.alias("orig_bytes"),
        d("l_partkey").cast("double").alias("resp_bytes"),
        d("l_suppkey").cast("double").alias("missed_bytes"),
        d("l_linenumber").cast("double").alias("orig_pkts"),
        (price * (1 - d("l_discount"))).alias("orig_ip_bytes"),
        (d("l_quantity") / 2).alias("resp_pkts"),
        (price * (1 + d("l_tax"))).alias("resp_ip_bytes"),
        (d("l_linenumber") == 7).cast("double").alias("proto_icmp"),
        (d("l_linestatus") == "F").cast("double").alias("proto_tcp"),
        (d("l_linestatus") == "O").cast("double").alias("proto_udp"),
        *[(d("l_returnflag") == v).cast("double").alias(f"conn_state_{k}") for k, v in states.items()],
        F.when(attack, ATTACK).otherwise(BENIGN).alias("Label"),
    )


CONNECTION_IDS = ("l_orderkey", "l_partkey", "l_suppkey", "duration", "orig_bytes", "orig_pkts", "orig_ip_bytes", "resp_ip_bytes")

FLOWS_SQL = """
flows AS (
  SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supp_id,
         CAST(l_linenumber AS BIGINT) AS "Protocol", l_quantity AS "Flow Duration",
         l_extendedprice AS "Flow Bytes/s", l_quantity AS "Flow Packets/s",
         CAST(l_linenumber % 2 AS BIGINT) AS "Fwd PSH Flags", CAST(l_linenumber % 3 AS BIGINT) AS "Bwd PSH Flags",
         CAST(trunc(l_quantity) AS BIGINT) AS "Total Fwd Packets",
         CAST(l_linenumber AS BIGINT) AS "Total Backward Packets",
         l_discount AS "Flow IAT Mean", l_tax AS "Active Mean", l_discount AS "Idle Mean",
         CASE l_returnflag WHEN 'N' THEN 'Benign' WHEN 'A' THEN 'Syn' ELSE 'UDP' END AS "Family",
         CASE l_returnflag WHEN 'N' THEN 'Benign' ELSE 'DDoS' END AS "Label",
         l_linestatus AS "Status"
  FROM lineitem)
"""

DERIVED_SQL = """
derived AS (
  SELECT *, "Fwd PSH Flags" / ("Bwd PSH Flags" + 1e-6) AS "PSH Flags Ratio",
         "Flow Packets/s" / ("Flow Bytes/s" + 1e-6) AS "Flow Packets/Bytes Ratio",
         "Total Fwd Packets" + "Total Backward Packets" AS "Total Packets",
         "Active Mean" - "Idle Mean" AS "Active-Idle Mean Diff"
  FROM flows)
"""

EVENTS_SQL = """
ev AS (SELECT *, CASE WHEN event_type = 'error' THEN 'DDoS' ELSE 'Benign' END AS "Label" FROM events)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as feature vectors with a cluster id."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster")
    )
