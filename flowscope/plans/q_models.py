"""Queries over classifiers and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.operators import evaluate as V
from flowscope.operators import supervised as M
from flowscope.plans import bindings as B
from flowscope.plans.q_report import rounded
from flowscope.plans.registry import query
from flowscope.sources.flows import FEATURE_SETS

FEATURES = ["Flow Duration", "Flow Bytes/s", "Flow IAT Mean", "Active Mean", "Protocol"]
SAFE = ["duration", "bytes", "iat", "active", "protocol"]


def training_flows(spark, sf_dir):
    """Flow features with a label that partly follows from them."""
    d = B.flows(spark, sf_dir)
    attack = ((F.col("Label") == "DDoS") & (F.col("Flow Duration") > 5)) | (F.col("Flow Bytes/s") > 60000)
    return d.select(
        *[F.col(f"`{i}`").alias(i.replace(" ", "_").replace("/", "_")) for i in ("order_id", "part_id", "supp_id")],
        *[F.col(f"`{f}`").cast("double").alias(s) for f, s in zip(FEATURES, SAFE, strict=True)],
        F.when(attack, "DDoS").otherwise("Benign").alias("Label"),
        F.col("Status"),
    )


IDS = ["order_id", "part_id", "supp_id", "duration", "bytes", "iat", "active", "protocol"]

# A deterministic prediction of the event type, right for most rows.
PREDICTED_SQL = """
pr AS (SELECT event_id, event_type AS truth, CASE WHEN event_id % 5 = 0 THEN 'click' WHEN event_id % 7 = 0 THEN 'error' ELSE event_type END AS predicted,
  least(value / 500, 1.0) AS score, event_type = 'error' AS positive FROM events)
"""
CLASSES = ["click", "error", "purchase", "signup", "view"]


@query(
    "auc_with_gaps",
    """WITH s AS (SELECT event_type = 'error' AS y, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS x FROM events),
       c AS (SELECT x, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM s WHERE x IS NOT NULL GROUP BY x),
       r AS (SELECT p, n, sum(p) OVER (ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS tp FROM c)
       SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM r""",
)
def auc_with_gaps(spark, sf_dir):
    """Area under the curve of scores that are NaN or infinite in some rows."""
    k, x = F.col("event_id"), F.col("value")
    broken = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(x)
    df = B.table(spark, sf_dir, "events").withColumn("x", broken)
    return rounded(V.auc(df, "x", F.col("event_type") == "error"), "auc")


def predictions(spark, sf_dir):
    k = F.col("event_id")
    guess = F.when(k % 5 == 0, "click").when(k % 7 == 0, "error").otherwise(F.col("event_type"))
    return B.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("truth"), guess.alias("predicted"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), (F.col("event_type") == "error").alias("positive"),
    )


@query("forest_scores")
def forest_scores(spark, sf_dir):
    """Random forest on a stratified 75/25 split of all flows: scores per class."""
    model, scored = M.train_and_score(training_flows(spark, sf_dir), SAFE, "Label", IDS, M.forest(20, 6))
    return V.class_scores(scored, "Label", "predicted", M.labels_of(model))


LABELLED_SQL = """
f AS (SELECT l_linestatus AS cluster, CASE WHEN (l_returnflag <> 'N' AND l_quantity > 5) OR l_extendedprice > 60000 THEN 'DDoS' ELSE 'Benign' END AS y FROM lineitem),
c AS (SELECT cluster, y, count(*) AS n FROM f GROUP BY 1, 2)
"""


@query(
    "forest_per_cluster",
    f"""WITH {LABELLED_SQL}
        SELECT cluster, CASE WHEN count(*) < 2 THEN 'skipped: single class' WHEN min(n) < 2 THEN 'skipped: class too small' ELSE 'trained' END AS status,
          CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, CASE WHEN count(*) > 1 AND min(n) > 1 THEN CAST(sum(ceil(n * 0.25)) AS BIGINT) END AS n_test,
          CASE WHEN count(*) > 1 AND min(n) > 1 THEN true END AS beats_guessing FROM c GROUP BY cluster""",
)
def forest_per_cluster(spark, sf_dir):
    """A forest of 100 trees without a depth limit per cluster, all grown together; better than the largest class as a guess."""
    df = training_flows(spark, sf_dir)
    out = M.train_per_cluster(df, SAFE, "Label", "Status", IDS)
    counts = df.groupBy("Status", "Label").agg(F.count(F.lit(1)).alias("n"))
    guess = counts.groupBy(F.col("Status").alias("cluster")).agg((100 * F.max("n") / F.sum("n")).alias("guess"))
    return out.join(guess, "cluster", "left").select("cluster", "status", "rows", "classes", "n_test", (F.col("accuracy_pct") > F.col("guess")).alias("beats_guessing"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    df = training_flows(spark, sf_dir)
    return M.importances(M.fit_whole(df, SAFE, "Label", M.forest(20, 6)), SAFE, df, 3)


@query("cluster_feature_importance")
def cluster_feature_importance(spark, sf_dir):
    df = training_flows(spark, sf_dir).withColumn("cluster", (F.col("duration") > 25).cast("int"))
    return M.cluster_importances(df, SAFE, "cluster", trees=10)


@query("boosted_tree_scores")
def boosted_tree_scores(spark, sf_dir):
    model, scored = M.train_and_score(training_flows(spark, sf_dir), SAFE, "Label", IDS, M.boosted(10, 4), 0.2)
    return V.class_scores(scored, "Label", "predicted", M.labels_of(model))


@query("network_scores")
def network_scores(spark, sf_dir):
    """Feed-forward network on all flows."""
    model, scored = M.train_and_score(
        training_flows(spark, sf_dir), SAFE, "Label", IDS, M.network(len(SAFE), 2, (32, 16), max_iter=30), 0.2
    )
    return V.class_scores(scored, "Label", "predicted", M.labels_of(model))


@query("cross_validation")
def cross_validation(spark, sf_dir):
    df = training_flows(spark, sf_dir)
    return M.fold_summary(M.cross_validate(df, SAFE, "Label", IDS))


@query("forest_sweep")
def forest_sweep(spark, sf_dir):
    """All depths, numbers of trees and training shares at the operator's own settings: 3,000 trees."""
    return M.sweep_forest(training_flows(spark, sf_dir), SAFE, "Label", IDS)


@query(
    "feature_set_comparison",
    """WITH f AS (SELECT CASE WHEN (l_returnflag <> 'N' AND l_quantity > 5) OR l_extendedprice > 60000 THEN 'DDoS' ELSE 'Benign' END AS class, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT s AS feature_set, class, CAST(ceil(n * 0.25) AS BIGINT) AS support, true AS learnt FROM f, (SELECT unnest(['Default', 'A', 'B']) AS s)""",
)
def feature_set_comparison(spark, sf_dir):
    """One forest of 100 trees without a depth limit per named feature set on the connection log, same split."""
    df = B.connections(spark, sf_dir)
    out = M.compare_feature_sets(df, FEATURE_SETS, "Label", B.CONNECTION_IDS)
    # The features decide the label, so a forest of any of these sets has to find it.
    return out.select("feature_set", "class", "support", (F.col("f1") > 0.9).alias("learnt"))


@query(
    "named_feature_sets",
    """SELECT 'Default' AS feature_set, count(*) AS n, round(sum(l_linenumber + l_extendedprice * (1 - l_discount) + l_quantity
          + l_suppkey + l_extendedprice + l_extendedprice * (1 + l_tax) + 1) + count(*) FILTER (l_returnflag <> 'N') + count(*) FILTER (l_linenumber = 7), 1) AS total FROM lineitem
       UNION ALL SELECT 'A', count(*), round(sum(l_linenumber + l_extendedprice * (1 - l_discount) + l_quantity + l_extendedprice + l_partkey + 1)
          + count(*) FILTER (l_returnflag <> 'N'), 1) FROM lineitem
       UNION ALL SELECT 'B', count(*), round(sum(l_linenumber + l_extendedprice * (1 - l_discount) + l_quantity) + count(*) FILTER (l_returnflag <> 'N'), 1) FROM lineitem""",
)
def named_feature_sets(spark, sf_dir):
    """Totals over the columns of the named feature sets."""
    df = B.connections(spark, sf_dir)
    parts = []
    for name in ("Default", "A", "B"):
        chosen = df.select(*FEATURE_SETS[name])
        per_row = sum((F.col(c) for c in chosen.columns), F.lit(0.0))
        parts.append(
            chosen.agg(F.lit(name).alias("feature_set"), F.count(F.lit(1)).alias("n"), F.round(F.sum(per_row), 1).alias("total"))
        )
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


SCORES_SQL = f"""{PREDICTED_SQL},
cl AS (SELECT DISTINCT truth AS class FROM pr),
m AS (SELECT class, count(*) FILTER (truth = class AND predicted = class) AS tp, count(*) FILTER (predicted = class) AS fl,
  count(*) FILTER (truth = class) AS support FROM cl, pr GROUP BY 1),
s AS (SELECT class, support, coalesce(tp / nullif(fl, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM m),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, coalesce(5 * p * r / nullif(4 * p + r, 0), 0) AS f2 FROM s)
"""


@query(
    "class_scores",
    f"""WITH {SCORES_SQL} SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS fbeta FROM f""",
)
def class_scores(spark, sf_dir):
    out = V.class_scores(predictions(spark, sf_dir), "truth", "predicted", CLASSES)
    return rounded(out, "precision", "recall", "f1", "fbeta")


@query(
    "accuracy",
    f"WITH {PREDICTED_SQL} SELECT count(*) AS n, round(avg(CAST(truth = predicted AS DOUBLE)) * 100, 6) AS accuracy_pct FROM pr",
)
def accuracy(spark, sf_dir):
    return rounded(V.accuracy_pct(predictions(spark, sf_dir), "truth", "predicted"), "accuracy_pct")


@query(
    "classification_report",
    f"""WITH {SCORES_SQL} SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
        UNION ALL SELECT 'accuracy', round(sum(r * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
)
def classification_report(spark, sf_dir):
    out = V.classification_report(predictions(spark, sf_dir), "truth", "predicted", CLASSES)
    return rounded(out, "precision", "recall", "f1")


@query(
    "confusion_matrix",
    f"""WITH {PREDICTED_SQL}, cl AS (SELECT DISTINCT truth AS c FROM pr), fr AS (SELECT a.c AS truth, b.c AS predicted FROM cl a, cl b),
        n AS (SELECT truth, predicted, count(*) AS n FROM pr GROUP BY 1, 2)
        SELECT fr.truth, fr.predicted, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM pr), 6) AS share_pct
        FROM fr LEFT JOIN n USING (truth, predicted)""",
)
def confusion_matrix(spark, sf_dir):
    return rounded(V.confusion(predictions(spark, sf_dir), "truth", "predicted", CLASSES), "share_pct")


@query(
    "binary_confusion",
    f"""WITH {PREDICTED_SQL}, c AS (SELECT CASE WHEN positive THEN CASE WHEN predicted = 'error' THEN 'TP' ELSE 'FN' END
          ELSE CASE WHEN predicted = 'error' THEN 'FP' ELSE 'TN' END END AS cell FROM pr),
        f AS (SELECT unnest(['TN', 'FP', 'FN', 'TP']) AS cell)
        SELECT f.cell, count(c.cell) AS n, round(count(c.cell) * 100.0 / (SELECT count(*) FROM pr), 6) AS share_pct FROM f LEFT JOIN c ON c.cell = f.cell GROUP BY 1""",
)
def binary_confusion(spark, sf_dir):
    return rounded(V.binary_cells(predictions(spark, sf_dir), F.col("positive"), F.col("predicted") == "error"), "share_pct")


ROC_SQL = f"""{PREDICTED_SQL},
g AS (SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM pr GROUP BY 1),
c AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM g
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


@query(
    "roc_curve",
    f"""WITH {ROC_SQL} SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / tot_p, 6) AS tpr, round(fp / tot_n, 6) AS fpr FROM c""",
)
def roc_curve(spark, sf_dir):
    return rounded(V.roc_curve(predictions(spark, sf_dir), "score", F.col("positive")), "tpr", "fpr")


@query(
    "roc_auc",
    f"""WITH {ROC_SQL} SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
        round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 9) AS auc FROM c""",
)
def roc_auc(spark, sf_dir):
    return V.auc(predictions(spark, sf_dir), "score", F.col("positive")).withColumn("auc", F.round("auc", 9))


@query(
    "roc_auc_micro",
    f"""WITH {PREDICTED_SQL}, l AS (SELECT score AS s, truth = 'error' AS y FROM pr UNION ALL SELECT 1 - score, truth = 'view' FROM pr UNION ALL SELECT score / 2, truth = 'click' FROM pr),
        r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM l)
        SELECT count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives,
          round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS auc FROM r""",
)
def roc_auc_micro(spark, sf_dir):
    """Micro-averaged area over three one-vs-rest scores."""
    df = predictions(spark, sf_dir).withColumns({"s_view": 1 - F.col("score"), "s_click": F.col("score") / 2})
    rows = V.micro_average_rows(df, "truth", {"error": "score", "view": "s_view", "click": "s_click"})
    return V.auc(rows, "score", F.col("positive")).withColumn("auc", F.round("auc", 9))


@query(
    "log_loss",
    f"""WITH {PREDICTED_SQL}, c AS (SELECT positive::INT AS y, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM pr)
        SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM c""",
)
def log_loss(spark, sf_dir):
    return rounded(V.log_loss(predictions(spark, sf_dir), F.col("positive"), F.col("score")), "log_loss")


@query(
    "score_verdicts",
    f"WITH {PREDICTED_SQL} SELECT truth, CASE WHEN score > 0.05 THEN 'Block' ELSE 'Pass' END AS verdict, count(*) AS n FROM pr GROUP BY 1, 2",
)
def score_verdicts(spark, sf_dir):
    df = predictions(spark, sf_dir)
    return df.groupBy("truth", V.verdict(F.col("score"), 0.05).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "missed_by_both",
    "SELECT event_id, event_type AS truth FROM events WHERE event_id % 15 = 0 AND event_type <> 'click'",
)
def missed_by_both(spark, sf_dir):
    """Rows that two rule-based models both get wrong."""
    df = B.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("truth"))
    first = df.withColumn("predicted", F.when(F.col("event_id") % 5 == 0, "click").otherwise(F.col("truth")))
    second = df.withColumn("predicted", F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.col("truth")))
    return V.missed_by_both(first, second, "truth", "predicted", "event_id").select("event_id", "truth")
