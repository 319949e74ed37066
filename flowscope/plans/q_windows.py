"""Queries over row windows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.operators import windows as W
from flowscope.operators.index import with_entity_index, with_file_row_index
from flowscope.plans import bindings as B
from flowscope.plans.q_report import rounded
from flowscope.plans.registry import query

WINDOWS_SQL = """
c AS (SELECT event_id // 100 AS window_id, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT window_id, n / sum(n) OVER (PARTITION BY window_id) AS p FROM c),
w AS (SELECT window_id, -sum(p * log2(p)) AS h1, -log2(sum(p * p)) AS h2, -log2(max(p)) AS hm FROM p GROUP BY 1)
"""
MEASURES = ["event_type_shannon", "event_type_renyi_2", "event_type_min_entropy"]


def window_vectors(spark, sf_dir):
    return W.tumbling_entropy(B.table(spark, sf_dir, "events"), "event_id", ["event_type"], as_type="string")


@query(
    "window_entropy_class_shares",
    f"""WITH {WINDOWS_SQL}, l AS (SELECT 'event_type_shannon' AS feature, round(h1, 9) AS x FROM w UNION ALL
          SELECT 'event_type_renyi_2', round(h2, 9) FROM w UNION ALL SELECT 'event_type_min_entropy', round(hm, 9) FROM w),
        s AS (SELECT feature, avg(x) AS mu, stddev_samp(x) AS sd FROM l GROUP BY 1)
        SELECT feature, round(count(*) FILTER (x < mu - sd) / count(*), 6) AS low_proportion,
          round(count(*) FILTER (x > mu + sd) / count(*), 6) AS high_proportion FROM l JOIN s USING (feature) GROUP BY 1""",
)
def window_entropy_class_shares(spark, sf_dir):
    """Entropies per 100-row window, classed around mean +- sigma, as shares per entropy."""
    vectors = window_vectors(spark, sf_dir).withColumns({m: F.round(m, 9) for m in MEASURES})
    shares = W.class_shares(W.classify_by_sigma(vectors, MEASURES), MEASURES)
    return rounded(shares, "low_proportion", "high_proportion")


@query(
    "sliding_window_entropy",
    """WITH r AS (SELECT a.event_id, b.event_type, count(*) AS n FROM events a JOIN events b
          ON b.event_id BETWEEN a.event_id - 63 AND a.event_id GROUP BY 1, 2)
       SELECT event_id, CASE WHEN event_id >= 63 THEN round(log2(64) - sum(n * log2(n)) / 64, 6) END AS entropy FROM r GROUP BY 1""",
)
def sliding_window_entropy(spark, sf_dir):
    out = W.sliding_entropy(B.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", 64)
    return rounded(out.select("event_id", "entropy"), "entropy")


@query(
    "sliding_histogram_entropy",
    """WITH e AS (SELECT event_id, least(floor(least(value / 500, 1.0) * 50), 49) AS bin FROM events),
       r AS (SELECT a.event_id, b.bin, count(*) AS n FROM e a JOIN e b ON b.event_id BETWEEN a.event_id - 255 AND a.event_id GROUP BY 1, 2)
       SELECT event_id, CASE WHEN event_id >= 255 THEN round(log2(256) - sum(n * log2(n)) / 256, 6) END AS entropy FROM r GROUP BY 1""",
)
def sliding_histogram_entropy(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("x"))
    return rounded(W.sliding_histogram_entropy(df, "event_id", "x").select("event_id", "entropy"), "entropy")


@query(
    "sliding_histogram_entropies",
    """WITH e AS (SELECT event_id, least(floor(least(value / 500, 1.0) * 50), 49) AS bin FROM events),
       r AS (SELECT a.event_id, b.bin, count(*) AS n FROM e a JOIN e b ON b.event_id BETWEEN a.event_id - 255 AND a.event_id GROUP BY 1, 2)
       SELECT event_id, CASE WHEN event_id >= 255 THEN round(ln(256) - sum(n * ln(n)) / 256, 6) END AS shannon,
         CASE WHEN event_id >= 255 THEN round(-ln(sum(n * n) / 65536.0), 6) END AS renyi,
         CASE WHEN event_id >= 255 THEN round(ln(256) - ln(max(n)), 6) END AS min_entropy FROM r GROUP BY 1""",
)
def sliding_histogram_entropies(spark, sf_dir):
    """Shannon, Renyi and min-entropy of the last 256 values, in nats."""
    df = B.table(spark, sf_dir, "events").select("event_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("x"))
    out = W.sliding_histogram_entropies(df, "event_id", "x", base=math.e)
    return rounded(out.drop("x"), "shannon", "renyi", "min_entropy")


@query(
    "tumbling_window_vectors",
    f"""WITH {WINDOWS_SQL}, cu AS (SELECT event_id // 100 AS window_id, user_id, count(*) AS n FROM events GROUP BY 1, 2),
        pu AS (SELECT window_id, n / sum(n) OVER (PARTITION BY window_id) AS p FROM cu),
        u AS (SELECT window_id, -sum(p * log2(p)) AS u1, -log2(sum(p * p)) AS u2, -log2(max(p)) AS um FROM pu GROUP BY 1)
        SELECT window_id, round(h1, 6) AS event_type_shannon, round(h2, 6) AS event_type_renyi_2, round(hm, 6) AS event_type_min_entropy,
          round(u1, 6) AS user_id_shannon, round(u2, 6) AS user_id_renyi_2, round(um, 6) AS user_id_min_entropy
        FROM w JOIN u USING (window_id)""",
)
def tumbling_window_vectors(spark, sf_dir):
    out = W.tumbling_entropy(B.table(spark, sf_dir, "events"), "event_id", ["event_type", "user_id"], as_type="string")
    return rounded(out, *[c for c in out.columns if c != "window_id"])


FLOW_SHORT = ("protocol", "duration", "psh", "ratio", "bytes", "packets", "iat", "idle")


def flow_window_sql() -> str:
    """Three entropies of eight integer features per 100 rows in file order."""
    rows = B.FLOWS_SQL.replace("FROM lineitem", "FROM numbered").replace("SELECT l_orderkey", "SELECT row_idx, l_orderkey")
    longs = " UNION ALL ".join(
        f"""SELECT row_idx // 100 AS window_id, '{s}' AS f, CAST(trunc("{c}") AS BIGINT) AS v FROM derived"""
        for c, s in zip(C.FLOW_FEATURES, FLOW_SHORT, strict=True)
    )
    columns = ", ".join(
        f"round(max(CASE WHEN f = '{s}' THEN {e} END), 6) AS {s}_{m}"
        for s in FLOW_SHORT
        for m, e in (("shannon", "h1"), ("renyi_2", "h2"), ("min_entropy", "hm"))
    )
    return f"""WITH numbered AS (SELECT row_number() OVER () - 1 AS row_idx, * FROM lineitem), {rows}, {B.DERIVED_SQL}, long AS ({longs}),
      c AS (SELECT window_id, f, v, count(*) AS n FROM long GROUP BY ALL), p AS (SELECT window_id, f, n / sum(n) OVER (PARTITION BY window_id, f) AS p FROM c),
      h AS (SELECT window_id, f, greatest(0.0, -sum(p * log2(p))) AS h1, greatest(0.0, -log2(sum(p * p))) AS h2, greatest(0.0, -log2(max(p))) AS hm FROM p GROUP BY ALL)
      SELECT window_id, {columns} FROM h GROUP BY window_id"""


@query("flow_window_vectors", flow_window_sql())
def flow_window_vectors(spark, sf_dir):
    """The whole flow file in 100-row windows, by file position: 24 entropies per window."""
    lines = with_file_row_index(spark, f"{sf_dir}/lineitem.parquet")
    df = B.flows(spark, sf_dir, lines).withColumns(C.derived_features())
    short = df.select("row_idx", *[C.integer_or_zero(C.quoted(f)).alias(s) for f, s in zip(C.FLOW_FEATURES, FLOW_SHORT, strict=True)])
    out = W.tumbling_entropy(short, "row_idx", FLOW_SHORT, as_type="bigint")
    return rounded(out, *[c for c in out.columns if c != "window_id"])


@query(
    "window_vector_rows",
    f"""WITH {WINDOWS_SQL} SELECT event_id, e.event_id // 100 AS window_id, round(h1, 6) AS event_type_shannon
        FROM events e JOIN w ON w.window_id = e.event_id // 100""",
)
def window_vector_rows(spark, sf_dir):
    df = B.table(spark, sf_dir, "events")
    vectors = W.tumbling_entropy(df, "event_id", ["event_type"], metrics=["shannon"], as_type="string")
    out = W.attach_window_vectors(df.select("event_id"), vectors, "event_id")
    return rounded(out, "event_type_shannon")


@query(
    "row_entropy_window_mean",
    """WITH v AS (SELECT event_id, unnest([user_id % 4, event_id % 3, CAST(trunc(value) AS BIGINT) % 5, user_id % 2]) AS x FROM events),
       c AS (SELECT event_id, x, count(*) AS n FROM v GROUP BY 1, 2),
       h AS (SELECT event_id, greatest(0.0, log2(4) - sum(n * log2(n)) / 4) AS h FROM c GROUP BY 1)
       SELECT event_id, round(h, 6) AS row_entropy, round(avg(h) OVER (PARTITION BY event_id // 100), 6) AS window_entropy FROM h""",
)
def row_entropy_window_mean(spark, sf_dir):
    d = F.col
    df = B.table(spark, sf_dir, "events").select(
        "event_id", (d("user_id") % 4).alias("a"), (d("event_id") % 3).alias("b"), (d("value").cast("bigint") % 5).alias("c"),
        (d("user_id") % 2).alias("d"),
    )
    out = W.row_entropy_window_mean(df, "event_id", ["a", "b", "c", "d"])
    return rounded(out.select("event_id", "row_entropy", "window_entropy"), "row_entropy", "window_entropy")


@query(
    "value_slope",
    "SELECT event_id, round(value - lag(value) OVER (ORDER BY event_id), 6) + 0.0 AS slope FROM events",
)
def value_slope(spark, sf_dir):
    out = W.slope(B.table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value")
    return out.select("event_id", (F.round("slope", 6) + 0.0).alias("slope"))


@query(
    "sigma_classes",
    """WITH s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events)
       SELECT event_type, CASE WHEN value < mu - sd THEN 'Low' WHEN value > mu + sd THEN 'High' ELSE 'Medium' END AS class, count(*) AS n
       FROM events, s GROUP BY 1, 2""",
)
def sigma_classes(spark, sf_dir):
    df = W.classify_by_sigma(B.table(spark, sf_dir, "events"), ["value"])
    return df.groupBy("event_type", F.col("Class_value").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fixed_length_sequences",
    """SELECT a.event_id, round(sum(b.value * (b.event_id - a.event_id + 20)), 4) AS mix, count(*) AS length, a.event_type AS label
       FROM events a JOIN events b ON b.event_id BETWEEN a.event_id - 19 AND a.event_id WHERE a.event_id >= 19 GROUP BY 1, 4""",
)
def fixed_length_sequences(spark, sf_dir):
    """Sequences of 20 rows, folded to one order-sensitive number each for comparison."""
    df = B.table(spark, sf_dir, "events")
    s = W.sequences(df, "event_id", ["value"], "event_type", 20)
    mix = F.aggregate(F.transform("sequence", lambda x, i: x[0] * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return s.select("event_id", F.round(mix, 4).alias("mix"), F.size("sequence").cast("bigint").alias("length"), "label")


@query(
    "entity_sliding_entropy",
    """WITH e AS (SELECT user_id, event_id, least(floor(least(value / 500, 1.0) * 50), 49) AS bin,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
       r AS (SELECT a.user_id, a.event_id, a.i, b.bin, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 15 AND a.i GROUP BY ALL)
       SELECT user_id, event_id, CASE WHEN i >= 16 THEN round(greatest(0.0, log2(16) - sum(n * log2(n)) / 16), 6) END AS entropy FROM r GROUP BY user_id, event_id, i""",
)
def entity_sliding_entropy(spark, sf_dir):
    """Sliding histogram entropy per user, by positions inside the user's rows."""
    df = B.table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("x")
    )
    placed = with_entity_index(df, ["user_id"], ["ts", "event_id"], unique=True)
    out = W.sliding_histogram_entropy(placed, "row_idx", "x", 16, entity=["user_id"])
    return rounded(out.select("user_id", "event_id", "entropy"), "entropy")
