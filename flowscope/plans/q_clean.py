"""Queries over cleaning, encoding and derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.operators import clean as K
from flowscope.operators.index import with_row_index
from flowscope.plans import bindings as B
from flowscope.plans.registry import query


def messy_orders(spark, sf_dir):
    """orders with blanks in names, infinities, nulls and text in a numeric column, all by rule."""
    o = B.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, float("inf")).when(k % 11 == 0, float("-inf")).when(k % 13 != 0, F.col("o_totalprice"))
    text = F.when(k % 5 == 0, "n/a").when(k % 3 != 0, F.col("o_custkey").cast("string"))
    return o.select(k.alias(" Flow ID"), price.alias("Flow Bytes/s "), text.alias(" Flow Packets"), F.col("o_orderstatus").alias(" Label "))


MESSY_SQL = """
messy AS (SELECT o_orderkey AS flow_id,
   CASE WHEN o_orderkey % 7 = 0 THEN CAST('inf' AS DOUBLE) WHEN o_orderkey % 11 = 0 THEN CAST('-inf' AS DOUBLE)
        WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS bytes,
   CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS packets,
   o_orderstatus AS label FROM orders)
"""


@query(
    "normalised_names",
    f"""WITH {MESSY_SQL} SELECT label AS "Label", count(*) AS n, CAST(sum(flow_id) AS BIGINT) AS ids FROM messy GROUP BY label""",
)
def normalised_names(spark, sf_dir):
    df = K.strip_names(messy_orders(spark, sf_dir))
    tight = K.squeeze_names(df)
    assert tight.columns == ["FlowID", "FlowBytes/s", "FlowPackets", "Label"]
    return tight.groupBy("Label").agg(F.count(F.lit(1)).alias("n"), F.sum("FlowID").alias("ids"))


@query(
    "bad_rows_dropped",
    f"""WITH {MESSY_SQL} SELECT label AS "Label", count(*) AS n, round(sum(bytes), 2) AS bytes FROM messy
        WHERE isfinite(bytes) AND packets IS NOT NULL GROUP BY label""",
)
def bad_rows_dropped(spark, sf_dir):
    df = K.drop_bad_rows(K.strip_names(messy_orders(spark, sf_dir)))
    return df.groupBy("Label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Flow Bytes/s"), 2).alias("bytes"))


@query(
    "coerced_numbers",
    f"""WITH {MESSY_SQL} SELECT label AS "Label", round(sum(coalesce(TRY_CAST(packets AS DOUBLE), 0)), 2) AS packets,
        count(*) AS n FROM messy GROUP BY label""",
)
def coerced_numbers(spark, sf_dir):
    df = K.coerce_numeric(K.strip_names(messy_orders(spark, sf_dir)), keep=["Label"])
    return df.groupBy("Label").agg(F.round(F.sum("Flow Packets"), 2).alias("packets"), F.count(F.lit(1)).alias("n"))


@query(
    "truncated_features",
    """SELECT CAST(trunc(l_discount * 100 - 3.5) AS BIGINT) AS cut, count(*) AS n FROM lineitem GROUP BY 1""",
)
def truncated_features(spark, sf_dir):
    df = B.table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100 - 3.5).alias("cut"))
    return K.truncate_features(df, ["cut"]).groupBy("cut").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mean_imputed",
    f"""WITH {MESSY_SQL}, m AS (SELECT flow_id, TRY_CAST(packets AS DOUBLE) AS p FROM messy)
        SELECT flow_id % 10 AS bucket, round(avg(coalesce(p, (SELECT avg(p) FROM m))), 6) AS packets FROM m GROUP BY 1""",
)
def mean_imputed(spark, sf_dir):
    df = K.strip_names(messy_orders(spark, sf_dir)).withColumn("p", F.col("Flow Packets").try_cast("double"))
    filled = K.impute_mean(df, ["p"])
    return filled.groupBy((F.col("Flow ID") % 10).alias("bucket")).agg(F.round(F.avg("p"), 6).alias("packets"))


@query(
    "numeric_selection",
    """SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey, CAST(sum(o_custkey) AS BIGINT) AS o_custkey,
              round(sum(o_totalprice), 1) AS o_totalprice FROM orders""",
)
def numeric_selection(spark, sf_dir):
    df = K.select_numeric(B.table(spark, sf_dir, "orders"))
    sums = [F.sum(c).alias(c) if t != "double" else F.round(F.sum(c), 1).alias(c) for c, t in df.dtypes]
    return df.agg(F.count(F.lit(1)).alias("n"), *sums)


@query(
    "collapsed_labels",
    f"""WITH {B.FLOWS_SQL} SELECT "Family" AS family, CASE WHEN "Family" = 'Benign' THEN 'Benign' ELSE 'DDoS' END AS collapsed,
        CASE WHEN "Family" = 'Syn' THEN 'Syn' ELSE 'Other' END AS one_vs_rest,
        CAST("Family" = 'UDP' AS INTEGER) AS bit, count(*) AS n FROM flows GROUP BY ALL""",
)
def collapsed_labels(spark, sf_dir):
    family = F.col("Family")
    return (
        B.flows(spark, sf_dir)
        .groupBy(
            family.alias("family"),
            C.collapse_label(family).alias("collapsed"),
            C.one_vs_rest(family, "Syn").alias("one_vs_rest"),
            C.label_bit(family, "UDP").alias("bit"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "label_set_filter",
    """SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events
       WHERE event_type IN ('error', 'click') GROUP BY event_type""",
)
def label_set_filter(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "click"))
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(
    "label_codes",
    """SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label_code, n
       FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""",
)
def label_codes(spark, sf_dir):
    df = K.label_codes(B.table(spark, sf_dir, "events"), "event_type")
    return df.groupBy("event_type", "label_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "one_hot_labels",
    """SELECT CAST(sum((event_type = 'click')::INT) AS BIGINT) AS click, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS error,
              CAST(sum((event_type = 'view')::INT) AS BIGINT) AS "view", user_id % 10 AS bucket FROM events GROUP BY bucket""",
)
def one_hot_labels(spark, sf_dir):
    classes = ["click", "error", "view"]
    df = K.one_hot_labels(B.table(spark, sf_dir, "events"), "event_type", classes)
    return df.groupBy((F.col("user_id") % 10).alias("bucket")).agg(*[F.sum(c).alias(c) for c in classes])


@query(
    "arg_max_column",
    """SELECT CASE WHEN l_quantity / 50 >= l_discount * 10 AND l_quantity / 50 >= l_tax * 12.5 THEN 'a'
                   WHEN l_discount * 10 >= l_tax * 12.5 THEN 'b' ELSE 'c' END AS winner, count(*) AS n
       FROM lineitem GROUP BY 1""",
)
def arg_max_column(spark, sf_dir):
    df = B.table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 12.5).alias("c")
    )
    return df.groupBy(C.arg_max(["a", "b", "c"]).alias("winner")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "derived_features",
    f"""WITH {B.FLOWS_SQL}, {B.DERIVED_SQL} SELECT "Family" AS family, count(*) AS n,
        round(avg("PSH Flags Ratio"), 2) AS psh, round(avg("Flow Packets/Bytes Ratio"), 9) AS ratio,
        CAST(sum("Total Packets") AS BIGINT) AS packets, round(avg("Active-Idle Mean Diff"), 6) AS diff
        FROM derived GROUP BY "Family" """,
)
def derived_features(spark, sf_dir):
    df = B.flows(spark, sf_dir).withColumns(C.derived_features())
    return df.groupBy(F.col("Family").alias("family")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(C.quoted(C.PSH_RATIO)), 2).alias("psh"),
        F.round(F.avg(C.quoted(C.PACKETS_PER_BYTE)), 9).alias("ratio"),
        F.sum(C.quoted(C.TOTAL_PACKETS)).alias("packets"),
        F.round(F.avg(C.quoted(C.ACTIVE_IDLE)), 6).alias("diff"),
    )


@query(
    "row_numbers",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS row_idx FROM lineitem)
       SELECT row_idx // 1000 AS block, count(*) AS n, CAST(sum(l_orderkey * 7 + row_idx) AS BIGINT) AS mix,
              round(sum(l_extendedprice), 2) AS price FROM r GROUP BY 1""",
)
def row_numbers(spark, sf_dir):
    df = with_row_index(B.table(spark, sf_dir, "lineitem"), B.LINE_IDS)
    return df.groupBy(F.expr("row_idx div 1000").alias("block")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_orderkey") * 7 + F.col("row_idx")).alias("mix"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


@query(
    "constant_columns_dropped",
    "SELECT count(*) AS n, round(sum(value), 2) AS value, CAST(sum(user_id) AS BIGINT) AS user_id FROM events",
)
def constant_columns_dropped(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("value", "user_id", F.lit(3.0).alias("flat"), F.lit(0).alias("zero"))
    kept = K.drop_constant_columns(df, ["value", "user_id", "flat", "zero"])
    aggs = {c: F.round(F.sum(c), 2) if c == "value" else F.sum(c) for c in kept.columns}
    return kept.agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in aggs.items()])


@query(
    "feature_sets",
    f"""WITH {B.FLOWS_SQL}, {B.DERIVED_SQL} SELECT "Protocol" AS protocol, round(sum("Flow Duration"), 2) AS duration,
        CAST(sum("Total Packets") AS BIGINT) AS packets FROM derived GROUP BY 1""",
)
def feature_sets(spark, sf_dir):
    df = B.flows(spark, sf_dir).withColumns(C.derived_features())
    chosen = df.select(*[C.quoted(c) for c in C.FLOW_FEATURES])
    return chosen.groupBy(F.col("Protocol").alias("protocol")).agg(
        F.round(F.sum("Flow Duration"), 2).alias("duration"), F.sum(C.quoted(C.TOTAL_PACKETS)).alias("packets")
    )


@query(
    "distinct_rows",
    "SELECT l_linenumber, l_quantity, l_discount + 0.0 AS l_discount, count(*) AS n FROM "
    "(SELECT DISTINCT l_linenumber, l_quantity, l_discount FROM lineitem) GROUP BY ALL",
)
def distinct_rows(spark, sf_dir):
    df = B.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", (F.col("l_discount") + 0.0).alias("l_discount"))
    return K.drop_duplicate_rows(df).groupBy("l_linenumber", "l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("n"))


@query(
    "weighted_features",
    "SELECT l_returnflag, round(sum(l_quantity * 0.25), 4) AS l_quantity, round(sum(l_tax * 3.0), 4) AS l_tax FROM lineitem GROUP BY 1",
)
def weighted_features(spark, sf_dir):
    df = K.weight_features(B.table(spark, sf_dir, "lineitem"), {"l_quantity": 0.25, "l_tax": 3.0})
    return df.groupBy("l_returnflag").agg(
        F.round(F.sum("l_quantity"), 4).alias("l_quantity"), F.round(F.sum("l_tax"), 4).alias("l_tax")
    )


@query(
    "melted_shares",
    """WITH w AS (SELECT l_linestatus AS method, l_returnflag AS cluster, count(*) FILTER (l_quantity <= 25) AS "Benign",
         count(*) FILTER (l_quantity > 25) AS "DDoS" FROM lineitem GROUP BY 1, 2),
       m AS (UNPIVOT w ON "Benign", "DDoS" INTO NAME class VALUE n)
       SELECT method, cluster, class, n, round(n * 100.0 / sum(n) OVER (PARTITION BY method, cluster), 6) AS cluster_pct,
              round(n * 100.0 / sum(n) OVER (PARTITION BY method), 6) AS method_pct FROM m""",
)
def melted_shares(spark, sf_dir):
    wide = (
        B.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linestatus").alias("method"), F.col("l_returnflag").alias("cluster"))
        .agg(F.count_if(F.col("l_quantity") <= 25).alias("Benign"), F.count_if(F.col("l_quantity") > 25).alias("DDoS"))
    )
    out = K.melt_shares(wide, "method", "cluster", ["Benign", "DDoS"])
    return out.withColumns({c: F.round(c, 6) for c in ("cluster_pct", "method_pct")})


@query(
    "relative_improvement",
    """WITH a AS (SELECT l_linenumber AS metric, avg(l_discount) FILTER (l_linestatus = 'F') AS base,
         avg(l_discount) FILTER (l_linestatus = 'O') AS new FROM lineitem GROUP BY 1)
       SELECT metric, round(CASE WHEN metric % 2 = 0 THEN -1 ELSE 1 END * (new - base) / abs(base) * 100, 6) AS improvement FROM a""",
)
def relative_improvement(spark, sf_dir):
    status = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_discount")))
    df = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("metric")).agg(
        status("F").alias("base"), status("O").alias("new")
    )
    change = C.relative_improvement(F.col("base"), F.col("new"), F.col("metric") % 2 == 0)
    return df.select("metric", F.round(change, 6).alias("improvement"))
