"""Population searches: swarms and bee colonies over centroids, mixture means, weights, thresholds.

The state of a search (P x dims numbers) lives on the driver. Every generation is scored by one
``evaluate`` call, which turns the whole population into one or two Spark jobs over a persisted
table; no candidate ever costs its own job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.functions.columns import quoted
from flowscope.operators import assign as A
from flowscope.operators import mixture as M
from flowscope.operators import quality as Q
from flowscope.operators.fit import lloyd
from flowscope.operators.reward import purity_loss
from flowscope.operators.sample import draw_seeds
from flowscope.session import spread

Evaluate = Callable[[np.ndarray], np.ndarray]

HISTORY_SCHEMA = "iteration int, best double"


@dataclass
class SearchResult:
    """Best position and score, and the best score after every iteration (start included)."""

    position: np.ndarray
    score: float
    history: list[float]
    stopped: str = "iterations"

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(v)) for i, v in enumerate(self.history)]
        return spark.createDataFrame(rows, HISTORY_SCHEMA)


def linear(start: float, end: float) -> Callable[[float], float]:
    """A coefficient that moves from ``start`` to ``end`` over the search."""
    return lambda progress: start + (end - start) * progress


def swarm(
    evaluate: Evaluate,
    lower: np.ndarray,
    upper: np.ndarray,
    particles: int = 30,
    iterations: int = 100,
    inertia: float | Callable[[float], float] = 0.5,
    pull_own: float | Callable[[float], float] = 0.5,
    pull_best: float | Callable[[float], float] = 0.5,
    feasible: Callable[[np.ndarray], np.ndarray] | None = None,
    min_step: float = 0.0,
    min_change: float = 0.0,
    exemplars: bool = False,
    seed: int = 42,
    start: np.ndarray | None = None,
) -> SearchResult:
    """Minimise over a box with a global-best swarm.

    ``feasible`` marks the positions that may become a best. The search stops when an improvement of
    the global best is at most ``min_change`` or moves it at most ``min_step``. With ``exemplars``
    each particle learns from the best of four mixes of its own and the global best, chosen by the
    two-level orthogonal design over three factors (the dimensions are dealt to the factors in turn).
    """
    lower, upper = np.asarray(lower, dtype=float), np.asarray(upper, dtype=float)
    if lower.shape != upper.shape:
        raise ValueError("bounds differ in length")
    if not np.all(upper > lower):
        raise ValueError("every upper bound must lie above its lower bound")
    rng = np.random.default_rng(seed)
    dims = len(lower)
    span = upper - lower
    x = lower + rng.random((particles, dims)) * span if start is None else np.clip(start, lower, upper)
    v = (rng.random((particles, dims)) * 2 - 1) * span
    allowed = (lambda p: np.ones(len(p), dtype=bool)) if feasible is None else feasible
    value = lambda c, t: c(t) if callable(c) else c

    own = x.copy()
    own_score = np.where(allowed(x), evaluate(x), np.inf)
    lead = int(own_score.argmin())
    best, best_score = own[lead].copy(), float(own_score[lead])
    history = [best_score]
    # The four runs of the three-factor, two-level orthogonal array.
    design = np.array([[0, 0, 0], [0, 1, 1], [1, 0, 1], [1, 1, 0]])
    for step in range(iterations):
        t = step / max(iterations - 1, 1)
        teacher = own
        if exemplars:
            factor = np.arange(dims) % 3
            mixes = np.stack([np.where(row[factor] == 1, best, own) for row in design])
            scores = evaluate(mixes.reshape(-1, dims)).reshape(len(design), particles)
            teacher = mixes[scores.argmin(axis=0), np.arange(particles)]
        r_own, r_best = rng.random((2, particles, dims))
        v = (
            value(inertia, t) * v
            + value(pull_own, t) * r_own * (teacher - x)
            + value(pull_best, t) * r_best * (best - x)
        )
        x = np.clip(x + v, lower, upper)
        score = np.where(allowed(x), evaluate(x), np.inf)
        better = score < own_score
        own[better], own_score[better] = x[better], score[better]
        lead = int(own_score.argmin())
        if own_score[lead] < best_score:
            change = best_score - own_score[lead]
            moved = float(np.linalg.norm(own[lead] - best))
            best, best_score = own[lead].copy(), float(own_score[lead])
            history.append(best_score)
            if change <= min_change:
                return SearchResult(best, best_score, history, "min_change")
            if moved <= min_step:
                return SearchResult(best, best_score, history, "min_step")
        else:
            history.append(best_score)
    return SearchResult(best, best_score, history)


def column_objective(
    spark: SparkSession, objective: Column, dims: int, feasible: Column | None = None
) -> tuple[Evaluate, Callable[[np.ndarray], np.ndarray]]:
    """Score a population with Column expressions over ``x0 .. x{dims-1}``: (evaluate, feasible)."""
    schema = ", ".join(["i int", *[f"x{d} double" for d in range(dims)]])

    def run(positions: np.ndarray, column: Column) -> np.ndarray:
        table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(positions)], schema)
        rows = table.select("i", column.alias("v")).collect()
        return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])

    def evaluate(positions: np.ndarray) -> np.ndarray:
        return run(positions, objective.cast("double")).astype(float)

    def allowed(positions: np.ndarray) -> np.ndarray:
        if feasible is None:
            return np.ones(len(positions), dtype=bool)
        return run(positions, F.coalesce(feasible, F.lit(False))).astype(bool)

    return evaluate, allowed


def threshold_errors(df: DataFrame, features: list[str], is_attack: Column) -> Evaluate:
    """Label errors of "all features above their thresholds is an attack", a whole population per job."""

    def evaluate(positions: np.ndarray) -> np.ndarray:
        counts = []
        for i, position in enumerate(positions):
            above = F.lit(True)
            for feature, cut in zip(features, position, strict=True):
                above = above & (quoted(feature) > F.lit(float(cut)))
            counts.append(F.count_if(above != is_attack).alias(f"e{i}"))
        return np.array(df.agg(*counts).first(), dtype=float)

    return evaluate


def feature_box(df: DataFrame, features: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value per feature; equal ends are widened a little."""
    x = quoted(features)
    lo = [F.min(F.element_at(x, i + 1)) for i in range(dims)]
    hi = [F.max(F.element_at(x, i + 1)) for i in range(dims)]
    row = df.agg(F.array(*lo).alias("lo"), F.array(*hi).alias("hi")).first()
    low, high = np.array(row["lo"], dtype=float), np.array(row["hi"], dtype=float)
    return low, np.where(high > low, high, low + 1e-9)


def swarm_centroids(
    df: DataFrame,
    k: int,
    particles: int = 40,
    iterations: int = 300,
    schedule: str = "linear",
    refine: bool = True,
    seed: int = 42,
    features: str = "features",
) -> tuple[np.ndarray, SearchResult]:
    """Centroids that minimise the composite score, then K-means from the best of them.

    ``linear`` lets the inertia fall from 0.9 to 0.4 (own 1.5, best 1.7) and scores by the composite;
    ``fixed`` uses inertia 0.9, own 0.7, best 0.5 and scores by the silhouette alone.
    """
    data = spread(A.pack(df, features)).persist()
    try:
        dims = A.first_dimensions(df, features)
        low, high = feature_box(df, features, dims)

        def evaluate(positions: np.ndarray) -> np.ndarray:
            table = Q.score_population(data, positions.reshape(-1, k, dims))
            if schedule == "linear":
                return table["score"].to_numpy()
            return np.where(table["clusters"] < 2, 0.0, -table["silhouette"].to_numpy())

        # The two coefficient settings.
        setting = {"linear": (linear(0.9, 0.4), 1.5, 1.7), "fixed": (0.9, 0.7, 0.5)}[schedule]
        result = swarm(
            evaluate, np.tile(low, k), np.tile(high, k), particles, iterations, *setting, seed=seed
        )
        centroids = result.position.reshape(k, dims)
        if refine:
            centroids, _ = lloyd(data, centroids)
    finally:
        data.unpersist()
    return centroids, result


def bee_colony(
    df: DataFrame,
    k: int,
    ids: list[str],
    bees: int = 10,
    iterations: int = 50,
    limit: int = 20,
    patience: int = 5,
    fitness: str = "davies_bouldin",
    refine_iterations: int = 0,
    seed: int = 42,
    features: str = "features",
) -> tuple[np.ndarray, SearchResult]:
    """Bee-colony search for ``k`` centroids: (centroids, result).

    Employed bees move one centroid of their own set, ``bees`` onlookers move sets drawn in
    proportion to fitness, scouts replace sets that failed ``limit`` times by drawn rows. With
    ``davies_bouldin`` a set is better in the order DB, silhouette, CH; with
    ``calinski_harabasz`` proposals are first refined by K-means and CH decides.
    """
    source = df.select(*[quoted(i) for i in ids], quoted(features).alias("features"))
    data = spread(A.pack(df, features)).persist()
    rng = np.random.default_rng(seed)
    by_ch = fitness == "calinski_harabasz"
    if not by_ch and fitness != "davies_bouldin":
        raise ValueError(f"unknown fitness: {fitness}")

    def rank(m: dict) -> tuple:
        return (m["calinski_harabasz"],) if by_ch else (-m["davies_bouldin"], m["silhouette"], m["calinski_harabasz"])

    def score(sets: np.ndarray) -> tuple[np.ndarray, list[dict]]:
        if refine_iterations:
            sets, _ = lloyd(data, sets, refine_iterations)
        table = Q.score_population(data, sets, shapes=not by_ch)
        return sets, table.to_dict("records")

    def draw(count: int, round_seed: int) -> np.ndarray:
        rows = draw_seeds(source, k, ids, count, round_seed).select("candidate", "seed_no", "features").collect()
        sets = np.zeros((count, k, len(rows[0]["features"])))
        for r in rows:
            sets[r["candidate"], r["seed_no"]] = r["features"]
        return sets

    def propose(sets: np.ndarray) -> np.ndarray:
        out = sets.copy()
        for s in range(len(sets)):
            if by_ch:
                other, j = sets[rng.integers(len(sets))], rng.integers(k)
                out[s, j] += rng.uniform(-1, 1) * (out[s, j] - other[j])
            else:
                i, j = rng.choice(k, 2, replace=False) if k > 1 else (0, 0)
                out[s, i] += rng.uniform(-1, 1, out.shape[2]) * (out[s, i] - out[s, j])
        return out

    def accept(targets, proposals, metrics) -> None:
        for t, p, m in zip(targets, proposals, metrics, strict=True):
            if rank(m) > rank(found[t]):
                colony[t], found[t], trials[t] = p, m, 0
            else:
                trials[t] += 1

    try:
        colony, found = score(draw(bees, seed))
        trials = np.zeros(bees, dtype=int)
        top = max(range(bees), key=lambda i: rank(found[i]))
        best, best_metrics = colony[top].copy(), found[top]
        worth = lambda m: -m["calinski_harabasz"] if by_ch else m["davies_bouldin"]
        history, idle, stopped = [worth(best_metrics)], 0, "iterations"
        for step in range(iterations):
            accept(range(bees), *score(propose(colony)))
            if by_ch:
                weight = np.array([max(m["calinski_harabasz"], 0.0) for m in found])
            else:
                weight = np.array([1.0 / (1.0 + m["davies_bouldin"]) for m in found])
            share = weight / weight.sum() if weight.sum() > 0 else None
            chosen = rng.choice(bees, bees, p=share)
            accept(chosen, *score(propose(colony[chosen])))
            spent = np.flatnonzero(trials >= limit)
            if len(spent):
                fresh, fresh_metrics = score(draw(len(spent), seed + 1_000 + step))
                for t, p, m in zip(spent, fresh, fresh_metrics, strict=True):
                    colony[t], found[t], trials[t] = p, m, 0
            top = max(range(bees), key=lambda i: rank(found[i]))
            if rank(found[top]) > rank(best_metrics):
                best, best_metrics, idle = colony[top].copy(), found[top], 0
            else:
                idle += 1
            history.append(worth(best_metrics))
            if idle >= patience:
                stopped = "patience"
                break
    finally:
        data.unpersist()
    return best, SearchResult(best.reshape(-1), worth(best_metrics), history, stopped)


def swarm_mixture_means(
    df: DataFrame,
    label: str,
    k: int = 2,
    particles: int = 30,
    iterations: int = 30,
    theta: float = 0.9,
    short: int = 5,
    long: int = 100,
    seed: int = 42,
    features: str = "features",
) -> tuple[M.Mixtures, SearchResult]:
    """Start means of a diagonal mixture that minimise the purity loss, then a long fit.

    Every particle runs ``short`` EM steps; all particles take each step in the same job.
    """
    data = spread(A.pack(df, features, label)).persist()
    try:
        dims = A.first_dimensions(df, features)
        low, high = feature_box(df, features, dims)
        spreads = M.column_variances(df, dims, features)

        def evaluate(positions: np.ndarray) -> np.ndarray:
            fitted = M.fit_mixtures(data, positions.reshape(-1, k, dims), short, 1e-3, spreads=spreads)
            return purity_loss(fitted.attacks, fitted.sizes, theta, min_share=0.05)

        result = swarm(
            evaluate, np.tile(low, k), np.tile(high, k), particles, iterations, 0.8, 1.5, 1.5, seed=seed
        )
        final = M.fit_mixtures(data, result.position.reshape(1, k, dims), long, 1e-4, spreads=spreads)
    finally:
        data.unpersist()
    return final, result


def swarm_feature_weights(
    df: DataFrame,
    label: str,
    means: np.ndarray,
    particles: int = 130,
    iterations: int = 20,
    theta: float = 0.85,
    em_iterations: int = 5,
    seed: int = 42,
    features: str = "features",
) -> tuple[np.ndarray, M.Mixtures, SearchResult]:
    """Feature weights in [0, 1] whose weighted mixture minimises the purity loss.

    ``means`` (K, D) start the mixture of every particle in unweighted units.
    """
    data = spread(A.pack(df, features, label)).persist()
    base = np.asarray(means, dtype=float)
    dims = base.shape[1]
    spreads = M.column_variances(df, dims, features)

    def fitted(weights: np.ndarray, steps: int) -> M.Mixtures:
        starts = base[None] * weights[:, None, :]
        return M.fit_mixtures(data, starts, steps, 1e-3, scales=weights, spreads=spreads)

    try:

        def evaluate(weights: np.ndarray) -> np.ndarray:
            m = fitted(weights, em_iterations)
            return purity_loss(m.attacks, m.sizes, theta, 0.7, 0.3, penalty=Q.PENALTY, graded=False)

        result = swarm(evaluate, np.zeros(dims), np.ones(dims), particles, iterations, 0.9, 1.5, 1.5, seed=seed)
        final = fitted(result.position[None], 100)
    finally:
        data.unpersist()
    return result.position, final, result


def swarm_reward_weights(
    clusters: DataFrame,
    particles: int = 400,
    iterations: int = 500,
    exemplars: bool = True,
    penalty: float = 10.0,
    seed: int = 42,
) -> SearchResult:
    """Search ``(w_attack, w_benign, theta)`` on fixed cluster counts.

    Inertia falls from 0.9 to 0.4 while the pull moves from the own to the global best. The counts
    are one row per cluster, so they are read once and the search itself needs no further job.
    """
    rows = clusters.select("attack", "benign").collect()
    attack = np.array([r["attack"] for r in rows], dtype=float)
    total = attack + np.array([r["benign"] for r in rows], dtype=float)

    def evaluate(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            purity = np.where(total > 0, attack / total, 0.0)
            benign = np.where(total > 0, 1 - purity, 0.0)
        term = -x[:, :1] * attack / total.sum() + x[:, 1:2] * benign
        pure = (purity[None, :] >= x[:, 2:3]) & (total > 0)
        return np.where(pure.any(axis=1), np.where(pure, term, np.inf).min(axis=1), penalty)

    # The box of (w_attack, w_benign, theta) and the coefficient schedules.
    low, high = np.array([0.0, 0.0, 0.5]), np.array([2.0, 2.0, 0.99])
    return swarm(
        evaluate, low, high, particles, iterations,
        linear(0.9, 0.4), linear(2.5, 0.5), linear(0.5, 2.5), exemplars=exemplars, seed=seed,
    )
