"""Cluster quality: silhouette, Calinski-Harabasz, Davies-Bouldin, composite score, agreement."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions.columns import quoted
from flowscope.operators import assign as A
from flowscope.operators.index import checked_broadcast

# Weights of the composite score, its CH divisor and the penalty for empty clusters.
SILHOUETTE_WEIGHT = 0.4
CH_WEIGHT = 0.3
DB_WEIGHT = 0.3
CH_DIVISOR = 10_000
PENALTY = 1e6

METRICS = ["candidate", "clusters", "n", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin"]


def cluster_moments(df: DataFrame, cluster: str, dims: int, features: str = "features") -> DataFrame:
    """``(cluster, n, sum_sq, sums)`` of a labelled table, all in the JVM with map-side sums."""
    x = quoted(features)
    parts = [F.sum(F.element_at(x, i + 1).cast("double")) for i in range(dims)]
    norm = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)
    return df.groupBy(quoted(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(norm).alias("sum_sq"), F.array(*parts).alias("sums")
    )


def _ch(n: np.ndarray, sums: np.ndarray, sum_sq: np.ndarray) -> tuple[float, float]:
    """(within-cluster sum of squares, Calinski-Harabasz)."""
    keep = n > 0
    n, sums, sum_sq = n[keep].astype(float), sums[keep], sum_sq[keep]
    total, k = n.sum(), len(n)
    own = np.einsum("ij,ij->i", sums, sums) / n
    within = float(np.maximum(sum_sq - own, 0.0).sum())
    grand = sums.sum(axis=0)
    between = float(own.sum() - grand @ grand / total)
    if k < 2 or total <= k:
        return within, float("-inf")
    return within, 1.0 if within == 0 else (between / (k - 1)) / (within / (total - k))


def _db(n: np.ndarray, sums: np.ndarray, sum_dist: np.ndarray) -> float:
    keep = n > 0
    if keep.sum() < 2:
        return float("inf")
    means = sums[keep] / n[keep][:, None]
    spread = sum_dist[keep] / n[keep]
    gaps = np.sqrt(A.squared_distances(means, means))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (spread[:, None] + spread[None, :]) / gaps
    np.fill_diagonal(ratio, -np.inf)
    return float(np.nan_to_num(ratio, nan=0.0, posinf=np.inf, neginf=-np.inf).max(axis=1).mean())


def _bundle(p: int, m: dict[str, np.ndarray], dist: np.ndarray, sil: np.ndarray) -> list:
    n = m["n"][p]
    within, ch = _ch(n, m["sums"][p], m["sum_sq"][p])
    filled = int((n > 0).sum())
    silhouette = float(sil[p].sum() / n.sum()) if filled > 1 else float("-inf")
    return [p, filled, int(n.sum()), within, silhouette, ch, _db(n, m["sums"][p], dist[p])]


def _shape_arrays(shapes: DataFrame, p_count: int, k_count: int) -> tuple[np.ndarray, np.ndarray]:
    dist, sil = np.zeros((p_count, k_count)), np.zeros((p_count, k_count))
    for row in shapes.collect():
        dist[row["candidate"], row["cluster"]] = row["sum_dist"]
        sil[row["candidate"], row["cluster"]] = row["sum_silhouette"]
    return dist, sil


def labelled_metrics(df: DataFrame, cluster: str, features: str = "features") -> pd.DataFrame:
    """One row of METRICS for a table with cluster labels; two passes, K rows on the driver.

    The silhouette is the squared-Euclid closed form that Spark's evaluator uses. With fewer than
    two clusters silhouette and CH are -inf and DB is +inf.
    """
    dims = A.dimensions(df, features)
    per = cluster_moments(df, cluster, dims, features).orderBy("cluster").collect()
    codes = {row["cluster"]: i for i, row in enumerate(per)}
    m = {
        "n": np.array([[r["n"] for r in per]]),
        "sums": np.array([[r["sums"] for r in per]], dtype=float),
        "sum_sq": np.array([[r["sum_sq"] for r in per]], dtype=float),
    }
    names = df.sparkSession.createDataFrame([(k, i) for k, i in codes.items()], f"k {df.schema[cluster].dataType.simpleString()}, code int")
    coded = df.join(checked_broadcast(names), quoted(cluster).eqNullSafe(F.col("k"))).select(quoted(features).alias("x"), "code")
    shapes = A.labelled_shapes(coded, "code", m["n"][0], m["sums"][0], m["sum_sq"][0], "x")
    dist, sil = _shape_arrays(shapes, 1, len(per))
    return pd.DataFrame([_bundle(0, m, dist, sil)], columns=METRICS)


def packed_metrics(data: DataFrame, k_count: int, dims: int) -> pd.DataFrame:
    """The same for packed rows whose labels are clusters 0..K-1."""
    m = A.label_moments(data, k_count, dims)
    dist, sil = _shape_arrays(A.labelled_shapes(data, "", m["n"][0], m["sums"][0], m["sum_sq"][0]), 1, k_count)
    return pd.DataFrame([_bundle(0, m, dist, sil)], columns=METRICS)


def composite(silhouette, ch, db, ch_mode: str = "linear"):
    """Composite score, lower is better; ``log`` mode takes log10 of CH above the divisor."""
    linear = -np.asarray(ch, dtype=float) / CH_DIVISOR * CH_WEIGHT
    if ch_mode == "log":
        with np.errstate(invalid="ignore", divide="ignore"):
            linear = np.where(np.asarray(ch) <= CH_DIVISOR, linear, -np.log10(np.asarray(ch, dtype=float)) * CH_WEIGHT)
    elif ch_mode != "linear":
        raise ValueError(f"unknown ch_mode: {ch_mode}")
    return -np.asarray(silhouette) * SILHOUETTE_WEIGHT + linear + np.asarray(db) * DB_WEIGHT


def composite_column(
    silhouette: Column, ch: Column, db: Column, clusters: Column, k: int, ch_mode: str = "linear"
) -> Column:
    """The composite score as a Column; candidates with fewer than ``k`` clusters get the penalty."""
    linear = -ch / CH_DIVISOR * CH_WEIGHT
    term = F.when(ch <= CH_DIVISOR, linear).otherwise(-F.log10(ch) * CH_WEIGHT) if ch_mode == "log" else linear
    return F.when(clusters < k, F.lit(PENALTY)).otherwise(-silhouette * SILHOUETTE_WEIGHT + term + db * DB_WEIGHT)


def score_population(
    df: DataFrame, population: np.ndarray, features: str = "features", label: str | None = None, shapes: bool = True
) -> pd.DataFrame:
    """METRICS plus ``score``, ``attack`` counts and cluster sizes for every candidate.

    Two jobs for the whole population: one for sums, one for distances to the means (skipped with
    ``shapes=False``). ``P x K`` rows come back.
    """
    sets = np.asarray(population, dtype=float)
    p_count, k_count, dims = sets.shape
    m = A.to_arrays(A.candidate_moments(df, sets, features, label), p_count, k_count, dims)
    if shapes:
        found = A.candidate_shapes(df, sets, m["n"], m["sums"], m["sum_sq"], features)
        dist, sil = _shape_arrays(found, p_count, k_count)
    else:
        dist = sil = np.zeros((p_count, k_count))
    table = pd.DataFrame([_bundle(p, m, dist, sil) for p in range(p_count)], columns=METRICS)
    with np.errstate(invalid="ignore"):
        score = composite(table["silhouette"], table["calinski_harabasz"], table["davies_bouldin"])
    table["score"] = np.where(table["clusters"] < k_count, PENALTY, score)
    # Inertia towards the given centroids, not the means of the clusters they make.
    table["inertia"] = m["inertia"].sum(axis=1)
    table["sizes"] = list(m["n"])
    table["attacks"] = list(m["attack"])
    return table


def calinski_harabasz(df: DataFrame, cluster: str, dims: int, features: str = "features") -> DataFrame:
    """``(clusters, n, within, between, calinski_harabasz)`` from moments only, one aggregate chain."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    per = cluster_moments(df, cluster, dims, features).withColumn("own", square(F.col("sums")) / F.col("n"))
    sums = [F.sum(F.element_at("sums", i + 1)) for i in range(dims)]
    total = per.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("n").alias("n"),
        F.sum(F.col("sum_sq") - F.col("own")).alias("within"),
        F.sum("own").alias("_own"),
        F.array(*sums).alias("_sums"),
    )
    with_between = total.withColumn("between", F.col("_own") - square(F.col("_sums")) / F.col("n"))
    ch = F.try_divide(
        F.col("between") / (F.col("clusters") - 1), F.col("within") / (F.col("n") - F.col("clusters"))
    )
    return with_between.select("clusters", "n", "within", "between", ch.alias("calinski_harabasz"))


def silhouette_on_sample(sample: DataFrame, cluster: str, size_limit: int, features: str = "features") -> float:
    """Mean Euclid silhouette inside a drawn sample of at most ``size_limit`` rows.

    The pairwise score is quadratic, so like a sample-size option it is offered for a sample only;
    the rows of the sample are spread over tasks and meet a broadcast copy of it.
    """
    rows = sample.select(quoted(cluster).alias("c"), quoted(features).alias("x"))
    held = rows.limit(size_limit + 1).collect()
    if len(held) > size_limit:
        raise ValueError("the sample is larger than size_limit; use the squared-Euclid silhouette")
    x = np.array([r["x"] for r in held], dtype=float)
    labels, codes = np.unique([r["c"] for r in held], return_inverse=True)
    sizes = np.bincount(codes)
    if len(labels) < 2:
        return float("-inf")
    local = sample.sparkSession.createDataFrame(
        [(int(i),) for i in range(len(x))], "i int"
    ).repartition(sample.sparkSession.sparkContext.defaultParallelism)

    def score(frames):
        for frame in frames:
            total = 0.0
            for i in frame["i"]:
                gaps = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
                per = np.bincount(codes, weights=gaps, minlength=len(sizes))
                mine = codes[i]
                if sizes[mine] < 2:
                    continue
                a = per[mine] / (sizes[mine] - 1)
                b = np.delete(per / sizes, mine).min()
                total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
            yield pd.DataFrame({"s": [total]})

    return local.mapInPandas(score, "s double").agg(F.sum("s")).first()[0] / len(x)


def better_first(metrics: DataFrame) -> DataFrame:
    """Candidates from best to worst: DB down, then silhouette up, then CH up."""
    return metrics.orderBy("davies_bouldin", F.desc("silhouette"), F.desc("calinski_harabasz"), "candidate")


def is_better(new: dict, old: dict) -> bool:
    """The same order for two metric bundles."""
    rank = lambda m: (-m["davies_bouldin"], m["silhouette"], m["calinski_harabasz"])
    return rank(new) > rank(old)


def adjusted_rand(df: DataFrame, first: str, second: str) -> DataFrame:
    """Adjusted Rand index of two labelings: ``(n, ari)``. Counts of counts only."""

    def pairs(c: Column) -> Column:
        return c.cast("double") * (c.cast("double") - 1) / 2

    cells = df.groupBy(quoted(first).alias("a"), quoted(second).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("v")).scalar()
    columns = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("v")).scalar()
    totals = cells.agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("both")).withColumns(
        {"rows": rows, "columns": columns}
    )
    expected = F.col("rows") * F.col("columns") / pairs(F.col("n"))
    top = (F.col("rows") + F.col("columns")) / 2
    ari = F.when(top == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (top - expected))
    return totals.select("n", ari.alias("ari"))


def stability(scores: Sequence[float]) -> tuple[float, float]:
    """Mean and population deviation of repeated agreement scores."""
    return float(np.mean(scores)), float(np.std(scores))
