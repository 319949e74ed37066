"""Queries that run a whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.operators.index import with_file_row_index
from flowscope.plans import bindings as B
from flowscope.plans import workflows as W
from flowscope.plans.q_report import rounded
from flowscope.plans.registry import query

SPLIT_FEATURES = ("Protocol", "Total Fwd Packets", "Total Backward Packets", "Fwd PSH Flags", "Bwd PSH Flags")


@query(
    "entropy_label_split",
    f"""WITH numbered AS (SELECT row_number() OVER () - 1 AS row_idx, * FROM lineitem),
        {B.FLOWS_SQL.replace("FROM lineitem", "FROM numbered").replace("SELECT l_orderkey", "SELECT row_idx, l_orderkey")},
        v AS (SELECT row_idx, unnest(["Protocol", "Total Fwd Packets", "Total Backward Packets", "Fwd PSH Flags", "Bwd PSH Flags"]) AS x FROM flows),
        c AS (SELECT row_idx, x, count(*) AS n FROM v GROUP BY 1, 2),
        h AS (SELECT row_idx, -log2(sum(n * n) / 25.0) AS h FROM c GROUP BY 1),
        w AS (SELECT row_idx, round(avg(h) OVER (PARTITION BY row_idx // 100), 9) AS x FROM h),
        l AS (SELECT x, "Family" = 'Syn' AS a FROM w JOIN flows USING (row_idx)),
        g AS (SELECT x, count(*) FILTER (a) AS a, count(*) FILTER (NOT a) AS b FROM l GROUP BY 1),
        r AS (SELECT x, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM g WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING))
        SELECT CAST(min(least(ca + tb - cb, cb + ta - ca)) AS BIGINT) AS errors, CAST(max(ta + tb) AS BIGINT) AS n FROM r""",
)
def entropy_label_split(spark, sf_dir):
    """Row entropy, window mean, best threshold against the label: its errors."""
    from flowscope.operators.reward import best_label_split

    df = B.flows(spark, sf_dir, with_file_row_index(spark, f"{sf_dir}/lineitem.parquet"))
    rows = W.window_entropies(df, "row_idx", "Syn", SPLIT_FEATURES)
    return best_label_split(rounded9(rows), "window_entropy", F.col("Family") == "Syn").select("errors", "n")


def rounded9(df):
    return df.withColumn("window_entropy", F.round("window_entropy", 9))


@query("entropy_split_purity")
def entropy_split_purity(spark, sf_dir):
    """Purity of the two clusters of the best entropy threshold."""
    df = B.flows(spark, sf_dir, with_file_row_index(spark, f"{sf_dir}/lineitem.parquet"))
    _, purity = W.entropy_label_split(df, "row_idx", "Family", "Syn", SPLIT_FEATURES)
    return rounded(purity, "purity", "attack_share", "benign_share")


@query("explored_clusters")
def explored_clusters(spark, sf_dir):
    """Bagged sample to outliers, importance, reduction, sweep and clusters: the purity report."""
    features = ["duration", "orig_bytes", "orig_ip_bytes", "resp_ip_bytes", "orig_pkts", "missed_bytes"]
    out = W.explore_clusters(
        B.connections(spark, sf_dir), features, "Label", B.CONNECTION_IDS, F.col("Label") == "DDoS", bags=2,
        ks=range(2, 4), max_iter=20,
    )
    return rounded(out["purity"], "purity", "attack_share", "benign_share")
