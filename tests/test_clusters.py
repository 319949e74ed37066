import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from flowscope.operators import assign as A
from flowscope.operators import fit as K
from flowscope.operators import iforest as I
from flowscope.operators import mixture as M
from flowscope.operators import quality as Q
from flowscope.operators import reward as W
from flowscope.operators import search as S
from flowscope.plans import workflows
from flowscope.session import local_session  # noqa: F401


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    centres = np.array([[0.0, 0, 0], [6, 0, 0], [0, 8, 0]])
    x = np.concatenate([c + rng.normal(size=(n, 3)) for c, n in zip(centres, (90, 60, 30), strict=True)])
    return x, np.repeat([0, 1, 2], [90, 60, 30]), centres


@pytest.fixture(scope="module")
def table(spark, blobs):
    x, y, _ = blobs
    rows = [(i, v.tolist(), int(c), int(c == 2)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id bigint, features array<double>, cluster int, y int").repartition(4).cache()


def brute(x, y):
    labels = np.unique(y)
    means = np.array([x[y == k].mean(axis=0) for k in labels])
    sq = ((x[:, None] - x[None]) ** 2).sum(axis=2)

    def silhouette(gaps):
        s = []
        for i in range(len(x)):
            own = (y == y[i]).sum()
            a = gaps[i, y == y[i]].sum() / (own - 1)
            b = min(gaps[i, y == k].mean() for k in labels if k != y[i])
            s.append((b - a) / max(a, b))
        return float(np.mean(s))

    within = sum(((x[y == k] - m) ** 2).sum() for k, m in zip(labels, means, strict=True))
    between = sum((y == k).sum() * ((m - x.mean(axis=0)) ** 2).sum() for k, m in zip(labels, means, strict=True))
    ch = (between / (len(labels) - 1)) / (within / (len(x) - len(labels)))
    spread = [np.sqrt(((x[y == k] - m) ** 2).sum(axis=1)).mean() for k, m in zip(labels, means, strict=True)]
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in range(len(labels)) if j != i) for i in range(len(labels))])
    return silhouette(sq), silhouette(np.sqrt(sq)), ch, db


def test_labelled_metrics_match_brute_force(table, blobs):
    x, y, _ = blobs
    sq, _, ch, db = brute(x, y)
    row = Q.labelled_metrics(table, "cluster").iloc[0]
    assert row["silhouette"] == pytest.approx(sq) and row["calinski_harabasz"] == pytest.approx(ch)
    assert row["davies_bouldin"] == pytest.approx(db)
    spark_value = ClusteringEvaluator(featuresCol="_vec", predictionCol="cluster").evaluate(K.with_vector(table))
    assert row["silhouette"] == pytest.approx(spark_value)


def test_euclid_silhouette_on_a_sample(table, blobs):
    x, y, _ = blobs
    assert Q.silhouette_on_sample(table, "cluster", 1_000) == pytest.approx(brute(x, y)[1])
    with pytest.raises(ValueError):
        Q.silhouette_on_sample(table, "cluster", 10)


def test_population_scores_match_single_scores(table, blobs):
    x, _, centres = blobs
    sets = np.stack([centres, centres * 0.3, np.full((3, 3), 50.0)])
    scores = Q.score_population(table, sets, label="y")
    for p in range(2):
        labels = A.squared_distances(x, sets[p]).argmin(axis=1)
        sq, _, ch, db = brute(x, labels)
        assert scores["silhouette"][p] == pytest.approx(sq) and scores["calinski_harabasz"][p] == pytest.approx(ch)
        assert scores["davies_bouldin"][p] == pytest.approx(db)
    assert scores["score"][2] == Q.PENALTY and scores["clusters"][2] == 1
    assert [int(a.sum()) for a in scores["attacks"]] == [30, 30, 30]


def test_one_cluster_falls_back(table):
    row = Q.labelled_metrics(table.withColumn("one", F.lit(0)), "one").iloc[0]
    assert row["silhouette"] == -np.inf and row["davies_bouldin"] == np.inf


def test_ties_go_to_the_lowest_index(spark):
    df = spark.createDataFrame([([0.0],)], "features array<double>")
    assert A.nearest(df, np.array([[1.0], [-1.0], [1.0]])).first()["cluster"] == 0


def test_lloyd_matches_numpy(table, blobs):
    x, _, centres = blobs
    c = centres + 1.5
    for _ in range(50):
        labels = A.squared_distances(x, c).argmin(axis=1)
        c = np.array([x[labels == k].mean(axis=0) for k in range(3)])
    found, inertia = K.lloyd(table, centres + 1.5, 50)
    assert np.allclose(found, c) and inertia == pytest.approx(A.squared_distances(x, c).min(axis=1).sum())


@pytest.mark.parametrize("fit", ["kmeans", "kmedoids", "hierarchical", "mixture"])
def test_fits_find_the_blobs(table, fit):
    df = table.drop("cluster")
    if fit == "kmeans":
        out = K.kmeans(df, 3, 3)[0]
    elif fit == "kmedoids":
        out = K.kmedoids(df, 3, ["id"], samples=2, sample_size=80)[0]
    elif fit == "hierarchical":
        out = K.hierarchical(df, 3)
    else:
        out = K.gaussian_mixture(df, 3)[0]
    both = out.join(table.select("id", F.col("cluster").alias("truth")), "id")
    assert Q.adjusted_rand(both, "cluster", "truth").first()["ari"] > 0.8


def test_bisecting_makes_k_groups(table):
    out = K.hierarchical(table.drop("cluster"), 3, "bisecting")
    assert out.select("cluster").distinct().count() == 3


def test_same_labels_agree_fully(table):
    row = Q.adjusted_rand(table.withColumn("other", 9 - F.col("cluster")), "cluster", "other").first()
    assert row["ari"] == pytest.approx(1.0)


def test_diagonal_em_matches_numpy(table, blobs):
    x, _, centres = blobs
    mu, var, w = centres.copy(), np.tile(x.var(axis=0), (3, 1)), np.full(3, 1 / 3)
    lik = []
    for _ in range(6):
        logs = np.log(w) - 0.5 * (((x[:, None] - mu) ** 2 / var) + np.log(2 * np.pi * var)).sum(axis=2)
        top = logs.max(axis=1, keepdims=True)
        lik.append(float((np.log(np.exp(logs - top).sum(axis=1)) + top[:, 0]).sum()))
        r = np.exp(logs - top)
        r /= r.sum(axis=1, keepdims=True)
        mass = r.sum(axis=0)
        mu = r.T @ x / mass[:, None]
        var = r.T @ (x * x) / mass[:, None] - mu**2
        w = mass / mass.sum()
    m = M.start_mixtures(table, centres[None])
    found = []
    for _ in range(6):
        m = M.em_step(table, m)
        found.append(float(m.log_lik[0]))
    assert found == pytest.approx(lik) and np.allclose(m.means[0], mu) and np.allclose(m.variances[0], var)
    assert all(b >= a - 1e-9 for a, b in zip(found, found[1:], strict=False))


def test_mixture_scales_equal_scaled_rows(table, blobs):
    _, _, centres = blobs
    w = np.array([0.5, 2.0, 1.0])
    scaled = table.withColumn("features", F.array(*[F.col("features")[i] * float(w[i]) for i in range(3)]))
    a = M.fit_mixtures(table, (centres * w)[None], 5, label="y", scales=w[None])
    b = M.fit_mixtures(scaled, (centres * w)[None], 5, label="y")
    assert np.allclose(a.means, b.means) and np.array_equal(a.sizes, b.sizes) and np.array_equal(a.attacks, b.attacks)
    labels = M.mixture_labels(table, a).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in labels} == {k: int(n) for k, n in enumerate(a.sizes[0]) if n}


def test_two_means_is_the_best_cut(spark):
    x = np.random.default_rng(3).integers(0, 60, 200).astype(float)
    best = min((((x[x <= c] - x[x <= c].mean()) ** 2).sum() + ((x[x > c] - x[x > c].mean()) ** 2).sum(), c) for c in np.unique(x)[:-1])
    df = K.two_means_1d(spark.createDataFrame([(float(v),) for v in x], "x double"), "x")
    assert df.filter("side = 'A'").agg(F.max("x")).first()[0] == best[1]
    lone = K.two_means_1d(spark.createDataFrame([(1.0,)], "x double"), "x")
    assert lone.first()["side"] == "A"


def test_label_split_is_the_best_cut(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 30, 300).astype(float), rng.random(300) < 0.4
    y = y ^ (x > 17)
    best = min(min((y != (x > c)).sum(), (y != (x <= c)).sum()) for c in np.unique(x))
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y, strict=True)], "x double, y boolean")
    row = W.best_label_split(df, "x", F.col("y")).first()
    assert row["errors"] == best and row["n"] == 300
    side = x > row["threshold"] if row["attack_above"] else x <= row["threshold"]
    assert (y != side).sum() == best


def test_purity_loss_forms_agree(spark):
    counts = [(80, 20), (5, 95), (50, 50)]
    df = spark.createDataFrame(counts, "attack bigint, benign bigint")
    attack, total = np.array([c[0] for c in counts]), np.array([sum(c) for c in counts])
    for theta in (0.5, 0.75, 0.9):
        a = W.purity_loss(attack, total, theta, 0.7, 0.3)[0]
        assert W.purity_loss_table(df, theta, 0.7, 0.3).first()["loss"] == pytest.approx(a)
    assert W.purity_loss(attack, total, 0.9)[0] == pytest.approx(1.1)
    assert W.purity_loss([[10, 1]], [[10, 990]], min_share=0.05)[0] == 10.0


def test_better_order():
    old = {"davies_bouldin": 1.0, "silhouette": 0.5, "calinski_harabasz": 10.0}
    assert Q.is_better({**old, "davies_bouldin": 0.9, "silhouette": 0.1}, old)
    assert Q.is_better({**old, "silhouette": 0.6}, old) and not Q.is_better(old, old)
    assert Q.composite(0.5, 20_000.0, 1.0, "log") == pytest.approx(-0.2 - 0.3 * np.log10(20_000) + 0.3)


def test_swarm_finds_a_minimum_and_respects_constraints():
    f = lambda p: ((p - np.array([1.0, 2.0])) ** 2).sum(axis=1)
    low, high = np.array([-5.0, -5]), np.array([5.0, 5])
    free = S.swarm(f, low, high, 40, 80, 0.6, 1.5, 1.5)
    assert free.score < 1e-3 and all(b <= a for a, b in zip(free.history, free.history[1:], strict=False))
    held = S.swarm(f, low, high, 40, 80, 0.6, 1.5, 1.5, feasible=lambda p: p[:, 0] <= 0)
    assert held.position[0] <= 0 and held.score == pytest.approx(1.0, abs=0.05)
    assert S.swarm(f, low, high, 10, 50, min_change=10.0).stopped == "min_change"
    with pytest.raises(ValueError):
        S.swarm(f, high, low)


def test_column_objective(spark):
    evaluate, allowed = S.column_objective(spark, (F.col("x0") - 1) * (F.col("x0") - 1) + F.col("x1"), 2, F.col("x1") > 0)
    p = np.array([[1.0, 2.0], [3.0, -1.0]])
    assert evaluate(p).tolist() == [2.0, 3.0] and allowed(p).tolist() == [True, False]


def test_searches_improve(table, blobs):
    _, _, centres = blobs
    found, result = S.swarm_centroids(table, 3, 10, 5)
    assert found.shape == (3, 3) and result.history[-1] <= result.history[0]
    _, bees = S.bee_colony(table, 3, ["id"], bees=6, iterations=3, limit=1)
    assert bees.history[-1] <= bees.history[0]
    _, mix = S.swarm_mixture_means(table, "y", 3, 6, 2, theta=0.8)
    assert mix.score <= mix.history[0]
    weights, _, run = S.swarm_feature_weights(table, "y", centres, 6, 2, theta=0.8)
    assert ((weights >= 0) & (weights <= 1)).all() and run.history[-1] <= run.history[0]


def test_outliers_are_found(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(400, 2)), np.array([[12.0, 12], [-11, 10], [9, -14], [15, 0]])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    out = I.flag_outliers(df, ["id"], 0.01, trees=50)
    assert {r["id"] for r in out.filter("is_outlier").collect()} >= {400, 401, 402, 403}
    row = I.removal_counts(out).first()
    assert row["n_before"] == 404 and row["n_removed"] <= 5


def test_isolation_paths_follow_the_nodes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    x[7, 1], x[8, 2] = np.nan, np.inf
    trees = [tuple(map(np.array, I._grow(rng.normal(size=(40, 3)), rng, 6))) for _ in range(9)]

    def length(row, tree):
        feature, cut, left, right, path = tree
        node = 0
        while feature[node] >= 0:
            node = left[node] if row[feature[node]] <= cut[node] else right[node]
        return path[node]

    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<double>").repartition(3)
    found = {r["id"]: r["anomaly"] for r in I.Forest(trees, 5.0, 6).score(df).collect()}
    for i, row in enumerate(x):
        assert found[i] == pytest.approx(2.0 ** -(np.mean([length(row, t) for t in trees]) / 5.0), rel=1e-12)
    assert I.Forest(trees, 5.0, 6).score(df.limit(0)).count() == 0


def test_exploration_fits_each_number_of_clusters_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, *(float(v) for v in rng.normal(8.0 * (i % 3), 1.0, 3)), "DDoS" if i % 3 else "Benign") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, Label string")
    fits, plain = [], K.best_kmeans
    monkeypatch.setattr(K, "best_kmeans", lambda data, k, *rest: fits.append(k) or plain(data, k, *rest))
    out = workflows.explore_clusters(df, ["a", "b", "c"], "Label", ["id"], F.col("Label") == "DDoS", bags=2, ks=range(2, 4), max_iter=20)
    assert fits == [3, 2, 3]
    sizes = sorted(r["total"] for r in out["purity"].collect())
    best = out["sweep"].where("best").first()
    assert len(sizes) == best["k"] and sum(sizes) == out["outliers"].first()["n_before"] - out["outliers"].first()["n_removed"]
