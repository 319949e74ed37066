"""Queries over distributions, cross-tabs and purity."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.operators import report as R
from flowscope.operators import windows as W
from flowscope.plans import bindings as B
from flowscope.plans.registry import query

# A rule-made cluster id on lineitem, mixed against the label.
CLUSTER_SQL = "CASE WHEN l_quantity > 40 THEN l_linenumber % 3 ELSE l_linenumber % 3 + 3 END"


def clustered(spark, sf_dir):
    d = B.flows(spark, sf_dir)
    third = F.col("Protocol") % 3
    attack = (F.col("Label") == "DDoS") & ((third != 1) | (F.col("Flow Duration") > 3)) | ((third == 0) & (F.col("Flow Duration") > 40))
    cluster = F.when(F.col("Flow Duration") > 40, third).otherwise(third + 3)
    return d.withColumns({"cluster": cluster, "is_attack": attack})


CLUSTERED_SQL = f"""
{B.FLOWS_SQL}, clustered AS (SELECT *, CASE WHEN "Flow Duration" > 40 THEN "Protocol" % 3 ELSE "Protocol" % 3 + 3 END AS cluster,
  ("Label" = 'DDoS' AND ("Protocol" % 3 <> 1 OR "Flow Duration" > 3)) OR ("Protocol" % 3 = 0 AND "Flow Duration" > 40) AS is_attack
  FROM flows),
per AS (SELECT cluster, count(*) AS total, count(*) FILTER (is_attack) AS attack, count(*) FILTER (NOT is_attack) AS benign
  FROM clustered GROUP BY cluster),
pur AS (SELECT *, attack / total AS purity FROM per)
"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "label_distribution",
    """SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1""",
)
def label_distribution(spark, sf_dir):
    return rounded(R.distribution(B.table(spark, sf_dir, "events"), "event_type"), "pct")


@query(
    "cluster_distribution",
    f"""WITH {CLUSTERED_SQL} SELECT cluster, total AS n, round(total * 100.0 / sum(total) OVER (), 6) AS pct FROM per""",
)
def cluster_distribution(spark, sf_dir):
    return rounded(R.distribution(clustered(spark, sf_dir), "cluster"), "pct")


@query(
    "cluster_share_of_label",
    f"""WITH {CLUSTERED_SQL} SELECT "Family" AS family, cluster, count(*) AS n,
        round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY "Family"), 6) AS pct
        FROM clustered WHERE "Family" IN ('Syn', 'UDP') GROUP BY 1, 2""",
)
def cluster_share_of_label(spark, sf_dir):
    out = R.share_within(clustered(spark, sf_dir), "Family", "cluster", ["Syn", "UDP"])
    return rounded(out.withColumnRenamed("Family", "family"), "pct")


@query(
    "cluster_label_crosstab",
    f"""WITH {CLUSTERED_SQL} SELECT cluster, round(count(*) FILTER ("Family" = 'Benign') * 100.0 / count(*), 6) AS "Benign",
        round(count(*) FILTER ("Family" = 'Syn') * 100.0 / count(*), 6) AS "Syn",
        round(count(*) FILTER ("Family" = 'UDP') * 100.0 / count(*), 6) AS "UDP" FROM clustered GROUP BY cluster""",
)
def cluster_label_crosstab(spark, sf_dir):
    names = ["Benign", "Syn", "UDP"]
    return rounded(R.crosstab_pct(clustered(spark, sf_dir), "cluster", "Family", names), *names)


@query(
    "cluster_verdicts",
    f"""WITH {CLUSTERED_SQL} SELECT cluster, total, attack, benign, round(attack * 100.0 / total, 6) AS attack_pct,
        round(benign * 100.0 / total, 6) AS benign_pct, CASE WHEN cluster = -1 THEN 'noise' WHEN attack * 100.0 / total > 80 THEN 'attack'
        WHEN benign * 100.0 / total > 80 THEN 'benign' ELSE 'mixed' END AS verdict FROM per""",
)
def cluster_verdicts(spark, sf_dir):
    return rounded(R.cluster_verdicts(clustered(spark, sf_dir), "cluster", F.col("is_attack")), "attack_pct", "benign_pct")


@query(
    "cluster_purity",
    f"""WITH {CLUSTERED_SQL} SELECT cluster, total, attack, benign, round(purity, 6) AS purity,
        round(attack / sum(attack) OVER (), 6) AS attack_share, round(benign / sum(benign) OVER (), 6) AS benign_share,
        least(attack, benign) AS misassigned FROM pur""",
)
def cluster_purity(spark, sf_dir):
    out = R.purity(clustered(spark, sf_dir), "cluster", F.col("is_attack"))
    return rounded(out, "purity", "attack_share", "benign_share")


@query(
    "high_purity_recall",
    f"""WITH {CLUSTERED_SQL}, s AS (SELECT count(*) FILTER (purity >= 0.7) AS clusters,
          coalesce(sum(attack) FILTER (purity >= 0.7), 0) AS a, coalesce(sum(benign) FILTER (purity >= 0.7), 0) AS b,
          sum(attack) AS ta, sum(benign) AS tb FROM pur)
        SELECT clusters, CAST(a AS BIGINT) AS attack_caught, CAST(b AS BIGINT) AS benign_caught, round(a / ta, 6) AS recall,
          round(b / (a + b), 6) AS benign_in_flagged, round(b / tb, 6) AS false_positive_rate FROM s""",
)
def high_purity_recall(spark, sf_dir):
    pur = R.purity(clustered(spark, sf_dir), "cluster", F.col("is_attack"))
    return rounded(R.high_purity_scores(pur, 0.7), "recall", "benign_in_flagged", "false_positive_rate")


@query(
    "traffic_aggregates",
    f"""WITH {B.FLOWS_SQL} SELECT "Label" AS label, count(*) AS n_flows, round(avg(CAST("Fwd PSH Flags" > 0 AS DOUBLE)), 6) AS psh_share,
        round(avg("Flow Duration"), 6) AS mean_length FROM flows GROUP BY 1""",
)
def traffic_aggregates(spark, sf_dir):
    out = R.traffic_aggregates(B.flows(spark, sf_dir), "Fwd PSH Flags", ["Packet Length", "Flow Duration"], ["Label"])
    return rounded(out.withColumnRenamed("Label", "label"), "psh_share", "mean_length")


@query(
    "phase_means",
    """WITH c AS (SELECT event_id // 100 AS window_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
       w AS (SELECT window_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY 1),
       p AS (SELECT * FROM (VALUES ('early', 0, 30), ('middle', 20, 70), ('late', 70, NULL)) t(phase, a, b))
       SELECT phase, count(*) AS windows, round(avg(h), 6) AS event_type_shannon FROM w JOIN p ON window_id >= a AND (b IS NULL OR window_id < b) GROUP BY phase""",
)
def phase_means(spark, sf_dir):
    w = W.tumbling_entropy(B.table(spark, sf_dir, "events"), "event_id", ["event_type"], metrics=["shannon"], as_type="string")
    phases = {"early": (0, 30), "middle": (20, 70), "late": (70, None)}
    return rounded(R.phase_means(w, "window_id", phases, ["event_type_shannon"]), "event_type_shannon")


@query(
    "feature_bounds",
    """SELECT 'l_quantity' AS feature, min(l_quantity) AS lower, max(l_quantity) AS upper FROM lineitem
       UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem""",
)
def feature_bounds(spark, sf_dir):
    return R.feature_bounds(B.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


@query(
    "class_guard",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' OR user_id % 3 = 0 GROUP BY 1, 2),
       g AS (SELECT user_id, count(*) AS classes, min(n) AS smallest, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY 1)
       SELECT user_id, classes, smallest, rows, CASE WHEN classes < 5 THEN 'skipped: single class'
         WHEN smallest < 8 THEN 'skipped: class too small' ELSE 'trained' END AS status FROM g""",
)
def class_guard(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").filter((F.col("event_type") != "view") | (F.col("user_id") % 3 == 0))
    guard = R.class_guard(df, "user_id", "event_type", 5, 8).drop("class_distribution")
    return guard.withColumnRenamed("cluster", "user_id")
