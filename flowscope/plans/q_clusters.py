"""Queries over clustering, cluster quality and population searches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.operators import assign as A
from flowscope.operators import fit as K
from flowscope.operators import mixture as M
from flowscope.operators import quality as Q
from flowscope.operators import report as R
from flowscope.operators import reward as W
from flowscope.operators import search as S
from flowscope.operators import stats as T
from flowscope.plans import bindings as B
from flowscope.plans.q_report import CLUSTERED_SQL, clustered, rounded
from flowscope.plans.registry import query
from flowscope.session import spread

DIMS = 64

# Embeddings in long form, cluster means, and squared distances of every row to every mean.
EMB_SQL = """
e AS (SELECT vec_id, label, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
mu AS (SELECT label AS k, d, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2),
nn AS (SELECT label AS k, count(*) AS n FROM embeddings GROUP BY 1),
dist AS (SELECT e.vec_id, mu.k, sum((x - m) * (x - m)) AS d2 FROM e JOIN mu USING (d) GROUP BY 1, 2)
"""
SHAPE_SQL = f"""{EMB_SQL},
within AS (SELECT label AS k, sum(d2) AS w FROM dist JOIN embeddings USING (vec_id) WHERE k = label GROUP BY 1),
mean2 AS (SELECT vec_id, label, k, d2 + w / nn.n AS md, nn.n FROM dist JOIN within USING (k) JOIN nn USING (k) JOIN embeddings USING (vec_id)),
ab AS (SELECT vec_id, max(CASE WHEN k = label THEN md * n / (n - 1) END) AS a, min(CASE WHEN k <> label THEN md END) AS b FROM mean2 GROUP BY 1),
sil AS (SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM ab),
spread AS (SELECT label AS k, avg(sqrt(d2)) AS s FROM dist JOIN embeddings USING (vec_id) WHERE k = label GROUP BY 1),
gap AS (SELECT a.k AS i, b.k AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g FROM mu a JOIN mu b ON a.d = b.d AND a.k <> b.k GROUP BY 1, 2),
ratio AS (SELECT i, max((si.s + sj.s) / g) AS r FROM gap JOIN spread si ON si.k = i JOIN spread sj ON sj.k = j GROUP BY 1),
db AS (SELECT avg(r) AS davies_bouldin FROM ratio),
grand AS (SELECT d, avg(x) AS m FROM e GROUP BY 1),
bet AS (SELECT sum(n * (mu.m - g.m) * (mu.m - g.m)) AS b FROM mu JOIN grand g USING (d)),
ch AS (SELECT count(*) AS clusters, sum(nn.n) AS n, sum(w) AS within, any_value(b) AS between,
  (any_value(b) / (count(*) - 1)) / (sum(w) / (sum(nn.n) - count(*))) AS calinski_harabasz FROM within JOIN nn USING (k), bet)
"""


def centroids_of(df):
    """Mean vector per label, in label order."""
    rows = Q.cluster_moments(df, "cluster", DIMS).orderBy("cluster").collect()
    return np.array([np.array(r["sums"]) / r["n"] for r in rows])


def flow_vectors(spark, sf_dir):
    """Standardised flow features as vectors with a 0/1 label."""
    names = ["Flow Duration", "Flow Bytes/s", "Flow IAT Mean", "Active Mean"]
    df = B.flows(spark, sf_dir)
    scaler = T.fit_standard_scaler(df, names)
    attack = ((F.col("Label") == "DDoS") & (F.col("Flow Duration") > 5)) | (F.col("Flow Bytes/s") > 60000)
    return df.select(
        *[C.quoted(i) for i in B.FLOW_IDS],
        F.array(*[scaler.scaled(c) for c in names]).alias("features"),
        attack.cast("int").alias("y"),
    )


@query(
    "nearest_centroid",
    f"""WITH {EMB_SQL} SELECT vec_id, CAST(min_by(k, d2) AS INTEGER) AS nearest, round(sqrt(min(d2)), 6) AS distance FROM dist GROUP BY 1""",
)
def nearest_centroid(spark, sf_dir):
    df = B.vectors(spark, sf_dir)
    out = A.nearest(df.select("vec_id", "features"), centroids_of(df), cluster="nearest")
    return rounded(out.select("vec_id", "nearest", "distance"), "distance")


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    """Best of three K-means runs with ten clusters on all embeddings."""
    out, _, _ = K.kmeans(B.vectors(spark, sf_dir).drop("cluster"), 10, restarts=3, max_iter=20)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(
    "kmeans_one_step",
    f"""WITH {EMB_SQL}, a AS (SELECT vec_id, min_by(k, d2) AS c FROM dist GROUP BY 1)
        SELECT CAST(c AS INTEGER) AS cluster, d AS dim, round(avg(x), 6) + 0.0 AS value FROM a JOIN e USING (vec_id) GROUP BY 1, 2""",
)
def kmeans_one_step(spark, sf_dir):
    """One K-means step from the label means."""
    df = B.vectors(spark, sf_dir)
    centroids, _ = K.lloyd(df, centroids_of(df), max_iter=1)
    rows = [(k, d, round(float(v), 6) + 0.0) for k, c in enumerate(centroids) for d, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, dim bigint, value double")


@query("kmeans_from_centroids")
def kmeans_from_centroids(spark, sf_dir):
    df = spread(B.vectors(spark, sf_dir)).persist()
    centroids, _ = K.lloyd(df, centroids_of(df), max_iter=20)
    df.unpersist()
    return A.nearest(df.select("vec_id", "features"), centroids).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.pow("distance", F.lit(2.0))), 6).alias("inertia")
    )


TWO_MEANS_SQL = """
c AS (SELECT round(value, 2) AS x, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT x, sum(n) OVER w AS cn, sum(n * x) OVER w AS cs, sum(n) OVER () AS tn, sum(n * x) OVER () AS ts FROM c
  WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT arg_max(x, cs * cs / cn + (ts - cs) * (ts - cs) / (tn - cn)) AS cut FROM r WHERE cn < tn)
"""


@query(
    "entropy_two_means",
    f"""WITH {TWO_MEANS_SQL} SELECT CASE WHEN value <= cut THEN 'A' ELSE 'B' END AS side, count(*) AS n, round(avg(value), 6) AS mean
        FROM events, cut GROUP BY 1""",
)
def entropy_two_means(spark, sf_dir):
    """Exact two-means split of one column into A and B."""
    df = K.two_means_1d(B.table(spark, sf_dir, "events"), "value")
    return df.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("kmedoids_clusters")
def kmedoids_clusters(spark, sf_dir):
    out, _, _ = K.kmedoids(B.vectors(spark, sf_dir).drop("cluster"), 10, ["vec_id"], samples=4, sample_size=200)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))


@query("mixture_clusters")
def mixture_clusters(spark, sf_dir):
    """Full-covariance mixture of three components on the flow features."""
    out, _ = K.gaussian_mixture(flow_vectors(spark, sf_dir), 3, max_iter=20)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("attack"))


EM_SQL = """
v AS (SELECT vec_id, d, x FROM e WHERE d < 4),
pv AS (SELECT d, var_pop(x) AS v FROM v GROUP BY 1),
st AS (SELECT label AS k, d, avg(x) AS m FROM e WHERE d < 4 AND label < 2 GROUP BY 1, 2),
ll AS (SELECT v.vec_id, st.k, sum(-0.5 * (x - m) * (x - m) / pv.v - 0.5 * ln(2 * pi() * pv.v)) + ln(0.5) AS l
  FROM v JOIN st USING (d) JOIN pv USING (d) GROUP BY 1, 2),
rr AS (SELECT vec_id, k, exp(l) / sum(exp(l)) OVER (PARTITION BY vec_id) AS r FROM ll)
"""


@query(
    "mixture_em_step",
    f"""WITH {EMB_SQL}, {EM_SQL} SELECT CAST(k AS INTEGER) AS component, d AS dim, round(sum(r * x) / sum(r), 6) + 0.0 AS mean,
        round(sum(r * x * x) / sum(r) - pow(sum(r * x) / sum(r), 2), 6) AS variance, round(sum(r) / count(*), 6) AS weight
        FROM rr JOIN v USING (vec_id) GROUP BY 1, 2""",
)
def mixture_em_step(spark, sf_dir):
    """One EM step of a diagonal mixture from the means of two labels, on four dimensions."""
    df = B.vectors(spark, sf_dir)
    low = df.withColumn("features", F.slice("features", 1, 4))
    start = centroids_of(df)[:2, :4]
    m = M.em_step(low, M.start_mixtures(low, start[None]))
    rows = [
        (k, d, round(float(m.means[0, k, d]), 6) + 0.0, round(float(m.variances[0, k, d]), 6), round(float(m.weights[0, k]), 6))
        for k in range(2)
        for d in range(4)
    ]
    return spark.createDataFrame(rows, "component int, dim bigint, mean double, variance double, weight double")


@query("mixture_from_means")
def mixture_from_means(spark, sf_dir):
    df = spread(flow_vectors(spark, sf_dir)).persist()
    start = np.array([[-1.0, -1.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0]])
    m = M.fit_mixtures(df, start[None], 30, label="y")
    df.unpersist()
    rows = [(k, int(m.sizes[0, k]), int(m.attacks[0, k]), float(m.weights[0, k])) for k in range(2)]
    return spark.createDataFrame(rows, "component int, n bigint, attack bigint, weight double")


@query("hierarchical_clusters")
def hierarchical_clusters(spark, sf_dir):
    out = K.hierarchical(B.vectors(spark, sf_dir).drop("cluster"), 10)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cluster_quality",
    f"""WITH {SHAPE_SQL} SELECT clusters, CAST(n AS BIGINT) AS n, round(within, 5) AS inertia, round(silhouette, 6) AS silhouette,
        round(calinski_harabasz, 5) AS calinski_harabasz, round(davies_bouldin, 6) AS davies_bouldin FROM ch, sil, db""",
)
def cluster_quality(spark, sf_dir):
    """Squared silhouette, Calinski-Harabasz and Davies-Bouldin of the label as a clustering."""
    table = Q.labelled_metrics(B.vectors(spark, sf_dir), "cluster").iloc[0]
    row = (
        int(table["clusters"]), int(table["n"]), round(float(table["inertia"]), 5), round(float(table["silhouette"]), 6),
        round(float(table["calinski_harabasz"]), 5), round(float(table["davies_bouldin"]), 6),
    )
    return spark.createDataFrame(
        [row], "clusters bigint, n bigint, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"
    )


@query(
    "calinski_harabasz",
    f"""WITH {SHAPE_SQL} SELECT clusters, CAST(n AS BIGINT) AS n, round(within, 5) AS within, round(between, 5) AS between,
        round(calinski_harabasz, 5) AS calinski_harabasz FROM ch""",
)
def calinski_harabasz(spark, sf_dir):
    out = Q.calinski_harabasz(B.vectors(spark, sf_dir), "cluster", DIMS)
    return out.withColumns({c: F.round(c, 5) for c in ("within", "between", "calinski_harabasz")})


@query("inertia_series")
def inertia_series(spark, sf_dir):
    """Inertia for each number of clusters, the last one included."""
    table = K.sweep(B.vectors(spark, sf_dir), range(2, 7), max_iter=30)
    return spark.createDataFrame(table[["k", "inertia"]])


@query(
    "inertia_of_centroids",
    f"""WITH {EMB_SQL}, n AS (SELECT vec_id, min(d2) AS d2 FROM dist GROUP BY 1) SELECT round(sum(d2), 5) AS inertia, count(*) AS n FROM n""",
)
def inertia_of_centroids(spark, sf_dir):
    df = B.vectors(spark, sf_dir)
    out = A.nearest(df.select("features"), centroids_of(df))
    return out.agg(F.round(F.sum(F.pow("distance", F.lit(2.0))), 5).alias("inertia"), F.count(F.lit(1)).alias("n"))


@query(
    "composite_score",
    f"""WITH {SHAPE_SQL} SELECT round(-silhouette * 0.4 - calinski_harabasz / 10000 * 0.3 + davies_bouldin * 0.3, 6) AS score,
        1000000.0::DOUBLE AS score_of_eleven FROM ch, sil, db""",
)
def composite_score(spark, sf_dir):
    """Composite score of the label clustering, and the penalty when eleven clusters were asked for."""
    table = spark.createDataFrame(Q.labelled_metrics(B.vectors(spark, sf_dir), "cluster"))
    parts = [F.col(c) for c in ("silhouette", "calinski_harabasz", "davies_bouldin", "clusters")]
    return table.select(
        F.round(Q.composite_column(*parts, 10), 6).alias("score"), Q.composite_column(*parts, 11).alias("score_of_eleven")
    )


@query(
    "population_scores",
    f"""WITH {EMB_SQL}, pop AS (SELECT p.p, mu.k, mu.d, mu.m * p.f AS m FROM mu, (VALUES (0, 1.0), (1, 0.5), (2, 1.5)) p(p, f)),
        pd AS (SELECT e.vec_id, p, k, sum((x - m) * (x - m)) AS d2 FROM e JOIN pop USING (d) GROUP BY 1, 2, 3),
        a AS (SELECT p, vec_id, min_by(k, d2) AS k, min(d2) AS d2 FROM pd GROUP BY 1, 2)
        SELECT CAST(p AS INTEGER) AS candidate, CAST(k AS INTEGER) AS cluster, count(*) AS n, round(sum(d2), 5) AS inertia FROM a GROUP BY 1, 2""",
)
def population_scores(spark, sf_dir):
    """Three centroid sets labelled and summed over all embeddings in one job."""
    df = B.vectors(spark, sf_dir)
    base = centroids_of(df)
    out = A.candidate_moments(df, np.stack([base, base * 0.5, base * 1.5]))
    return out.select("candidate", "cluster", "n", F.round("inertia", 5).alias("inertia"))


@query("best_candidate")
def best_candidate(spark, sf_dir):
    """Candidates ordered by DB, then silhouette, then CH."""
    df = B.vectors(spark, sf_dir)
    base = centroids_of(df)
    table = Q.score_population(df, np.stack([base, base * 0.5, base * 1.5]))
    scored = spark.createDataFrame(table.drop(columns=["sizes", "attacks"]))
    return Q.better_first(scored).select("candidate", "davies_bouldin", "silhouette", "calinski_harabasz", "score")


@query(
    "adjusted_rand",
    """WITH c AS (SELECT event_type AS a, user_id % 4 AS b, count(*) AS n FROM events GROUP BY 1, 2),
       r AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1)),
       k AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1)),
       s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS bb FROM c)
       SELECT CAST(n AS BIGINT) AS n, round((bb - r.v * k.v / (n * (n - 1) / 2)) / ((r.v + k.v) / 2 - r.v * k.v / (n * (n - 1) / 2)), 9) AS ari
       FROM s, r, k""",
)
def adjusted_rand(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("g"))
    return Q.adjusted_rand(df, "event_type", "g").withColumn("ari", F.round("ari", 9))


@query("clustering_stability")
def clustering_stability(spark, sf_dir):
    out = K.repeat_stability(B.vectors(spark, sf_dir), 10, ["vec_id"], repeats=2)
    return out.agg(F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"))


@query("algorithm_comparison")
def algorithm_comparison(spark, sf_dir):
    """K-means, hierarchy and mixture side by side on the flow features."""
    return spark.createDataFrame(K.compare(flow_vectors(spark, sf_dir), 3))


@query("cluster_count_sweep")
def cluster_count_sweep(spark, sf_dir):
    return spark.createDataFrame(K.sweep(flow_vectors(spark, sf_dir), range(2, 6), max_iter=30))


@query(
    "label_split_threshold",
    f"""WITH {CLUSTERED_SQL}, c AS (SELECT "Flow Bytes/s" AS x, count(*) FILTER (is_attack) AS a, count(*) FILTER (NOT is_attack) AS b FROM clustered GROUP BY 1),
        r AS (SELECT x, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))
        SELECT CAST(min(least(ca + tb - cb, cb + ta - ca)) AS BIGINT) AS errors, CAST(max(ta + tb) AS BIGINT) AS n FROM r""",
)
def label_split_threshold(spark, sf_dir):
    """Fewest label errors of any one-column threshold."""
    return W.best_label_split(clustered(spark, sf_dir), "Flow Bytes/s", F.col("is_attack")).select("errors", "n")


LOSS_SQL = f"""{CLUSTERED_SQL}, t AS (SELECT sum(total) AS n FROM per)"""


@query(
    "purity_reward",
    f"""WITH {LOSS_SQL} SELECT round(coalesce(min(CASE WHEN purity >= 0.7 THEN -0.7 * attack / n + 0.3 * benign / total END), 1.0 + 0.7 - max(purity)), 6) AS loss FROM pur, t""",
)
def purity_reward(spark, sf_dir):
    pur = R.purity(clustered(spark, sf_dir), "cluster", F.col("is_attack"))
    return rounded(W.purity_loss_table(pur.select("attack", "benign"), 0.7, 0.7, 0.3), "loss")


def reward_parameters(spark):
    steps = F.sequence(F.lit(0), F.lit(10))
    return (
        spark.range(1)
        .select(F.explode(steps).alias("i"))
        .select("i", F.explode(steps).alias("j"))
        .select("i", "j", F.explode(steps).alias("k"))
        .select((F.col("i") / 5.0).alias("w_attack"), (F.col("j") / 5.0).alias("w_benign"), (0.5 + F.col("k") * 0.049).alias("theta"))
    )


@query(
    "reward_grid",
    f"""WITH {LOSS_SQL}, g AS (SELECT i / 5.0 AS w_attack, j / 5.0 AS w_benign, 0.5 + k * 0.049 AS theta FROM (SELECT unnest(range(11)) AS i),
          (SELECT unnest(range(11)) AS j), (SELECT unnest(range(11)) AS k))
        SELECT round(w_attack::DOUBLE, 6) AS w_attack, round(w_benign::DOUBLE, 6) AS w_benign, round(theta::DOUBLE, 6) AS theta,
          round(coalesce(min(CASE WHEN purity >= theta::DOUBLE THEN -w_attack::DOUBLE * attack / n + w_benign::DOUBLE * benign / total END), 10.0), 6) + 0.0 AS loss
        FROM g, pur, t GROUP BY 1, 2, 3""",
)
def reward_grid(spark, sf_dir):
    """Loss of every point of a parameter grid on the purity counts."""
    pur = R.purity(clustered(spark, sf_dir), "cluster", F.col("is_attack"))
    out = rounded(W.reward_grid(pur, reward_parameters(spark)), "w_attack", "w_benign", "theta", "loss")
    return out.withColumn("loss", F.col("loss") + 0.0)


@query(
    "weighted_recall_grid",
    f"""WITH {LOSS_SQL}, s AS (SELECT coalesce(sum(attack) FILTER (purity >= 0.7), 0) AS a, coalesce(sum(benign) FILTER (purity >= 0.7), 0) AS b, sum(attack) AS ta FROM pur),
        g AS (SELECT i / 5.0 AS w_recall, j / 5.0 AS w_benign FROM (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS j))
        SELECT w_recall::DOUBLE AS w_recall, w_benign::DOUBLE AS w_benign, round(w_recall::DOUBLE * a / ta - w_benign::DOUBLE * b / (a + b), 6) + 0.0 AS objective FROM g, s""",
)
def weighted_recall_grid(spark, sf_dir):
    pur = R.purity(clustered(spark, sf_dir), "cluster", F.col("is_attack"))
    grid = reward_parameters(spark).filter(F.col("theta") == 0.5).select(F.col("w_attack").alias("w_recall"), "w_benign")
    out = rounded(W.weighted_recall(pur, grid, 0.7), "objective")
    return out.withColumn("objective", F.col("objective") + 0.0)


@query(
    "purity_routing",
    f"""WITH {CLUSTERED_SQL} SELECT cluster, CASE WHEN purity >= 0.75 THEN 'block' WHEN 1 - purity >= 0.75 THEN 'pass' ELSE 'stage2' END AS route, total AS n FROM pur""",
)
def purity_routing(spark, sf_dir):
    df = clustered(spark, sf_dir)
    pur = R.purity(df, "cluster", F.col("is_attack"))
    return W.route_by_purity(df, pur, "cluster", 0.75).groupBy("cluster", "route").agg(F.count(F.lit(1)).alias("n"))


@query("swarm_centroid_search")
def swarm_centroid_search(spark, sf_dir):
    """Best composite score after every generation of a centroid swarm on the flow features."""
    _, result = S.swarm_centroids(flow_vectors(spark, sf_dir), 3, particles=12, iterations=6)
    return result.table(spark)


@query("bounded_swarm")
def bounded_swarm(spark, sf_dir):
    """Threshold pair on duration and price with the fewest label errors, under an inequality."""
    df = spread(clustered(spark, sf_dir).select("Flow Duration", "Flow Bytes/s", "is_attack")).persist()
    evaluate = S.threshold_errors(df, ["Flow Duration", "Flow Bytes/s"], F.col("is_attack"))
    result = S.swarm(
        evaluate, np.array([0.0, 0.0]), np.array([51.0, 106_000.0]), 12, 8,
        feasible=lambda p: p[:, 1] - 1_000.0 * p[:, 0] >= -20_000.0, min_step=1e-8,
    )
    df.unpersist()
    return result.table(spark)


@query("bee_colony_refined")
def bee_colony_refined(spark, sf_dir):
    """Bee colony whose proposals are refined by K-means and judged by Calinski-Harabasz."""
    _, result = S.bee_colony(
        B.vectors(spark, sf_dir), 10, ["vec_id"], bees=5, iterations=2, limit=3,
        fitness="calinski_harabasz", refine_iterations=3,
    )
    return result.table(spark)


@query("bee_colony_search")
def bee_colony_search(spark, sf_dir):
    """Best Davies-Bouldin value after every round of a bee colony."""
    _, result = S.bee_colony(flow_vectors(spark, sf_dir), 3, list(B.FLOW_IDS), bees=8, iterations=4, limit=3)
    return result.table(spark)


@query("mixture_mean_search")
def mixture_mean_search(spark, sf_dir):
    """Purity loss after every generation of a search for mixture means."""
    _, result = S.swarm_mixture_means(flow_vectors(spark, sf_dir), "y", 2, particles=8, iterations=3, theta=0.75, short=3, long=10)
    return result.table(spark)


@query("feature_weight_search")
def feature_weight_search(spark, sf_dir):
    """Purity loss after every generation of a search for feature weights."""
    start = np.array([[-1.0, -1, 0, 0], [1, 1, 0, 0], [0, 1, 1, 0], [0, -1, 0, 1], [1, -1, 0, 0]], dtype=float)
    _, _, result = S.swarm_feature_weights(flow_vectors(spark, sf_dir), "y", start, particles=8, iterations=3, theta=0.75, em_iterations=3)
    return result.table(spark)


@query("reward_weight_search")
def reward_weight_search(spark, sf_dir):
    """Search of reward weights and threshold with orthogonal exemplars."""
    pur = R.purity(clustered(spark, sf_dir), "cluster", F.col("is_attack"))
    return S.swarm_reward_weights(pur, particles=60, iterations=60).table(spark)
