"""Fitting clusterings: K-means, mixtures, bisecting, medoids, one-dimensional two-means, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.functions.columns import quoted
from flowscope.operators import assign as A
from flowscope.operators import mixture as M
from flowscope.operators import quality as Q
from flowscope.operators import sample as P
from flowscope.operators.index import running_sums
from flowscope.session import cut_lineage, spread


def with_vector(df: DataFrame, features: str = "features", name: str = "_vec") -> DataFrame:
    return df.withColumn(name, array_to_vector(quoted(features)))


def _labelled(model, df: DataFrame, cluster: str) -> DataFrame:
    keep = [c for c in model.transform(df).columns if c not in ("_vec", "_prob")]
    out = model.transform(df).select(*[quoted(c) for c in keep])
    return out.drop(cluster).withColumnRenamed("_cluster", cluster)


def kmeans(
    df: DataFrame, k: int, restarts: int = 10, max_iter: int = 300, seed: int = 42, features: str = "features", cluster: str = "cluster"
) -> tuple[DataFrame, np.ndarray, float]:
    """Best of ``restarts`` K-means runs by cost: (labelled table, centroids, cost)."""
    vectors = spread(with_vector(df.select(quoted(features)), features)).persist()
    try:
        best = best_kmeans(vectors, k, restarts, max_iter, seed)
    finally:
        vectors.unpersist()
    return label_rows(best, df, features, cluster), np.array(best.clusterCenters()), float(best.summary.trainingCost)


def label_rows(model: KMeansModel, df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """``df`` with the cluster that a fitted model gives each row."""
    return _labelled(model, with_vector(df, features), cluster)


def best_kmeans(vectors: DataFrame, k: int, restarts: int, max_iter: int, seed: int) -> KMeansModel:
    """The cheapest of ``restarts`` fits on a persisted table with ``_vec``."""
    fits = KMeans(k=k, maxIter=max_iter, featuresCol="_vec", predictionCol="_cluster")
    models = [fits.copy({fits.seed: seed + run}).fit(vectors) for run in range(restarts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def start_centers(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The centres that Spark's K-means starts from on a table with ``_vec``."""
    return np.array(KMeans(k=k, maxIter=0, seed=seed, featuresCol="_vec", predictionCol="_cluster").fit(vectors).clusterCenters())


def lloyd(
    df: DataFrame, start: np.ndarray, max_iter: int = 300, tolerance: float = 1e-4, features: str = "features"
) -> tuple[np.ndarray, float]:
    """K-means from given centroids: (centroids, inertia). A cluster that empties keeps its place.

    ``start`` may also be a population (P, K, D); all of it moves in the same jobs. Persist ``df``.
    """
    current = np.asarray(start, dtype=float)
    single = current.ndim == 2
    current = current[None] if single else current
    shape = current.shape
    inertia = np.full(shape[0], np.inf)
    for _ in range(max_iter):
        m = A.to_arrays(A.candidate_moments(df, current, features), *shape)
        n = m["n"][:, :, None]
        moved = np.where(n > 0, m["sums"] / np.maximum(n, 1), current)
        inertia = m["inertia"].sum(axis=1)
        shift = ((moved - current) ** 2).sum(axis=2).max()
        current = moved
        if shift <= tolerance**2:
            break
    return (current[0], float(inertia[0])) if single else (current, inertia)


def gaussian_mixture(
    df: DataFrame, k: int, max_iter: int = 100, seed: int = 42, features: str = "features", cluster: str = "cluster"
) -> tuple[DataFrame, float]:
    """Full-covariance mixture: (labelled table, log-likelihood)."""
    vectors = with_vector(df, features)
    model = GaussianMixture(
        k=k, maxIter=max_iter, seed=seed, featuresCol="_vec", predictionCol="_cluster", probabilityCol="_prob"
    ).fit(vectors)
    return _labelled(model, vectors, cluster), float(model.summary.logLikelihood)


def _ward_groups(means: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Merge weighted means pairwise by the smallest growth of the within-group sum of squares."""
    groups = np.arange(len(means))
    mean, size = means.astype(float).copy(), sizes.astype(float).copy()
    alive = list(np.flatnonzero(size > 0))
    while len(alive) > k:
        live = np.array(alive)
        weight = size[live][:, None] * size[live][None] / (size[live][:, None] + size[live][None])
        growth = weight * A.squared_distances(mean[live], mean[live])
        np.fill_diagonal(growth, np.inf)
        i, j = np.unravel_index(growth.argmin(), growth.shape)
        keep, gone = live[min(i, j)], live[max(i, j)]
        mean[keep] = (mean[keep] * size[keep] + mean[gone] * size[gone]) / (size[keep] + size[gone])
        size[keep] += size[gone]
        groups[groups == gone] = keep
        alive.remove(gone)
    return np.searchsorted(alive, groups)


def _ward_cells(vectors: DataFrame, k: int, micro: int, seed: int) -> tuple[KMeansModel, Column]:
    """K-means cells of the rows, and the group of each cell as a constant array."""
    model = KMeans(k=max(k, micro), maxIter=20, seed=seed, featuresCol="_vec", predictionCol="_cluster").fit(vectors)
    groups = _ward_groups(np.array(model.clusterCenters()), np.array(model.summary.clusterSizes), k)
    return model, F.array(*[F.lit(int(g)) for g in groups])


def hierarchical(
    df: DataFrame,
    k: int,
    method: str = "ward",
    micro: int = 100,
    seed: int = 42,
    features: str = "features",
    cluster: str = "cluster",
) -> DataFrame:
    """Hierarchical grouping into ``k`` clusters at any table size.

    ``ward`` first condenses the rows into ``micro`` K-means cells and then merges the cells by
    Ward's rule, which needs only their means and sizes. ``bisecting`` divides from the top.
    """
    vectors = spread(with_vector(df.select(quoted(features)), features)).persist()
    try:
        if method == "bisecting":
            model = BisectingKMeans(k=k, seed=seed, featuresCol="_vec", predictionCol="_cluster").fit(vectors)
            return _labelled(model, with_vector(df, features), cluster)
        if method != "ward":
            raise ValueError(f"unknown method: {method}")
        model, cells = _ward_cells(vectors, k, micro, seed)
    finally:
        vectors.unpersist()
    return _labelled(model, with_vector(df, features), "_cell").withColumn(
        cluster, cells[F.col("_cell")]
    ).drop("_cell")


def _medoids(x: np.ndarray, k: int, plus_plus: bool, rng: np.random.Generator, max_iter: int = 300) -> np.ndarray:
    """Alternating K-medoids inside one sample."""
    gaps = np.sqrt(np.maximum(A.squared_distances(x, x), 0.0))
    if plus_plus:
        chosen = [int(rng.integers(len(x)))]
        while len(chosen) < k:
            weight = gaps[:, chosen].min(axis=1) ** 2
            total = weight.sum()
            chosen.append(int(rng.choice(len(x), p=weight / total if total > 0 else None)))
    else:
        chosen = list(rng.choice(len(x), k, replace=False))
    medoids = np.array(chosen)
    for _ in range(max_iter):
        labels = gaps[:, medoids].argmin(axis=1)
        moved = medoids.copy()
        for j in range(k):
            members = np.flatnonzero(labels == j)
            if len(members):
                moved[j] = members[gaps[np.ix_(members, members)].sum(axis=1).argmin()]
        if np.array_equal(moved, medoids):
            break
        medoids = moved
    return x[medoids]


def kmedoids(
    df: DataFrame,
    k: int,
    ids: Sequence[str],
    samples: int = 8,
    sample_size: int = 400,
    seed: int = 42,
    features: str = "features",
    cluster: str = "cluster",
) -> tuple[DataFrame, np.ndarray, pd.DataFrame]:
    """Medoids found on several hash samples, each in its own task and with two kinds of start; every
    set is then scored on the whole table and the best silhouette wins.

    The samples only propose medoids. The choice and the labels use every row.
    """
    data = spread(df.select(*[quoted(i) for i in ids], quoted(features).alias("x"))).persist()
    try:
        drawn = P.hash_picks(data, ids, samples, sample_size, seed).select("draw", "h", "x")

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            held = frame.sort_values("h").head(sample_size)
            x = np.array(held["x"].tolist(), dtype=float)
            s = int(frame["draw"].iloc[0])
            out = []
            if len(x) >= k:
                for kind in (True, False):
                    found = _medoids(x, k, kind, np.random.default_rng(seed + 2 * s + kind))
                    out.append((2 * s + int(kind), found.tolist()))
            return pd.DataFrame(out, columns=["set", "medoids"])

        sets = drawn.groupBy("draw").applyInPandas(solve, "set int, medoids array<array<double>>")
        found = sorted(sets.collect(), key=lambda r: r["set"])
        if not found:
            raise ValueError("fewer rows than clusters")
        population = np.array([r["medoids"] for r in found])
        scores = Q.score_population(data, population, "x")
    finally:
        data.unpersist()
    best = population[int(scores["silhouette"].to_numpy().argmax())]
    return A.nearest(df, best, features, cluster), best, scores


def two_means_1d(df: DataFrame, value: str, name: str = "side") -> DataFrame:
    """Label rows A (low) or B (high) by the exact two-means split of one column.

    The best threshold minimises the within-group sum of squares over all cuts between distinct
    values. One distinct value, or fewer than two rows, is a single cluster A. A row without a finite
    value has no label.
    """
    x = C.finite_or_null(quoted(value).cast("double"))
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    counts = cut_lineage(values.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    sums = running_sums(counts, "x", {"cn": F.col("n"), "cs": F.col("n") * F.col("x")})
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("s"))
    t = total.select(F.struct("n", "s")).scalar()
    between = F.col("cs") * F.col("cs") / F.col("cn") + F.pow(F.col("_t.s") - F.col("cs"), F.lit(2.0)) / (
        F.col("_t.n") - F.col("cn")
    )
    cut = (
        sums.withColumn("_t", t)
        .filter(F.col("cn") < F.col("_t.n"))
        .agg(F.max_by("x", F.struct(between, -F.col("x"))).alias("cut"))
        .scalar()
    )
    return df.withColumn("_cut", cut).withColumn(
        name, F.when(x.isNotNull() & (F.col("_cut").isNull() | (x <= F.col("_cut"))), "A").when(x.isNotNull(), "B")
    ).drop("_cut")


def sweep(
    df: DataFrame,
    ks: Sequence[int],
    restarts: int = 1,
    max_iter: int = 300,
    seed: int = 42,
    features: str = "features",
    fitted: dict[int, KMeansModel] | None = None,
) -> pd.DataFrame:
    """Metrics of a K-means for every ``k``; the largest silhouette is marked ``best``. The models are put into ``fitted``."""
    data = spread(with_vector(df.select(quoted(features).alias("features")))).persist()
    try:
        rows = []
        for k in ks:
            model = best_kmeans(data, k, restarts, max_iter, seed)
            if fitted is not None:
                fitted[k] = model
            centroids, cost = np.array(model.clusterCenters()), float(model.summary.trainingCost)
            scored = Q.score_population(data, centroids[None])
            rows.append(
                (k, cost, *[float(scored[c][0]) for c in ("silhouette", "calinski_harabasz", "davies_bouldin")])
            )
    finally:
        data.unpersist()
    table = pd.DataFrame(rows, columns=["k", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin"])
    table["best"] = table["silhouette"] == table["silhouette"].max()
    return table


def compare(df: DataFrame, k: int, seed: int = 42, features: str = "features") -> pd.DataFrame:
    """Metrics of K-means, the hierarchy and the mixture side by side."""
    rows = df.select(quoted(features).alias("features"))
    vectors = spread(with_vector(rows)).persist()
    try:
        dims = A.first_dimensions(rows)
        # Spark draws the starts; the steps from there run on blocks.
        cells = start_centers(vectors, max(k, 100), seed)
        means = start_centers(vectors, k, seed)
        start = GaussianMixture(k=k, maxIter=0, seed=seed, featuresCol="_vec", predictionCol="_cluster", probabilityCol="_prob").fit(vectors)
    finally:
        vectors.unpersist()
    gaussians = start.gaussiansDF.collect()
    data = spread(A.pack(rows)).persist()
    try:
        cells, _ = lloyd(data, cells, 20)
        sizes = A.to_arrays(A.candidate_moments(data, cells[None]), 1, *cells.shape)["n"][0]
        mixture = M.fit_full(
            data, np.array(start.weights), np.array([g["mean"].toArray() for g in gaussians]), np.array([g["cov"].toArray() for g in gaussians]), 100
        )
        labels = {
            "kmeans": A.nearest_labels(data, lloyd(data, means, 300)[0]),
            "hierarchical": A.nearest_labels(data, cells, _ward_groups(cells, sizes, k)),
            "gaussian_mixture": M.full_labels(data, *mixture),
        }
        tables = []
        for name, table in labels.items():
            metrics = Q.packed_metrics(table, k, dims)
            metrics.insert(0, "algorithm", name)
            tables.append(metrics)
    finally:
        data.unpersist()
    return pd.concat(tables, ignore_index=True).drop(columns="candidate")


def repeat_stability(
    df: DataFrame, k: int, ids: Sequence[str], repeats: int = 5, share: float = 0.8, seed: int = 42, features: str = "features"
) -> DataFrame:
    """Adjusted Rand of two differently seeded clusterings per repeated sample: ``(repeat, n, ari)``."""
    parts = []
    for r in range(repeats):
        rows = P.random_mask(df.select(*[quoted(i) for i in ids], quoted(features).alias("features")), share, ids, seed + r)
        _, first, _ = kmeans(rows, k, 1, seed=seed + 100 + r)
        _, second, _ = kmeans(rows, k, 1, seed=seed + 200 + r)
        both = A.nearest(A.nearest(rows, first, cluster="a", distance="_da"), second, cluster="b", distance="_db")
        parts.append(Q.adjusted_rand(both, "a", "b").select(F.lit(r).alias("repeat"), "n", "ari"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
