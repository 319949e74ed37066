"""Isolation forest: trees grown in parallel tasks on small hash samples, scores on every row."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.functions.columns import quoted
from flowscope.operators import sample as P
from flowscope.operators.assign import matrix_of
from flowscope.operators.stats import exact_quantiles
from flowscope.session import cut_lineage

TREE_SCHEMA = (
    "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"
)


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, ...]:
    feature, cut, left, right, path = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        feature.append(-1)
        cut.append(0.0)
        left.append(node)
        right.append(node)
        path.append(depth + average_path(len(rows)))
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            continue
        f = int(rng.choice(usable))
        at = float(rng.uniform(low[f], high[f]))
        feature[node], cut[node] = f, at
        under = x[rows, f] <= at
        todo.append((rows[~under], depth + 1, node, True))
        todo.append((rows[under], depth + 1, node, False))
    return feature, cut, left, right, path


@dataclass
class Forest:
    """Flat node arrays per tree; at most ``trees x 2 x sample`` nodes."""

    trees: list[tuple[np.ndarray, ...]]
    norm: float
    depth: int

    def score(self, df: DataFrame, features: str = "features", name: str = "anomaly") -> DataFrame:
        """Add the anomaly score in (0, 1]; higher is more isolated."""
        trees, norm, depth = self.trees, self.norm, self.depth
        # A node's children side by side, the right one first.
        trees = [(np.maximum(f, 0), cut, np.column_stack([right, left]).ravel(), path) for f, cut, left, right, path in trees]
        df = df.drop(name)
        names = list(df.columns)
        at = names.index(features)

        def run(batches):
            for batch in batches:
                x = matrix_of(batch.column(at)) if batch.num_rows else np.empty((0, 1))
                by_feature, rows = np.ascontiguousarray(x.T).ravel(), np.arange(len(x))
                total = np.zeros(len(x))
                for feature, cut, children, path in trees:
                    first = feature * len(x)
                    node = np.zeros(len(x), dtype=np.int64)
                    for _ in range(depth):
                        under = by_feature.take(first.take(node) + rows) <= cut.take(node)
                        node = children.take(2 * node + under)
                    total += path.take(node)
                value = np.power(2.0, -total / len(trees) / norm) if norm else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(len(names))], pa.array(value)], names=[*names, name]
                )

        return df.mapInArrow(run, T.StructType([*df.schema.fields]).add(name, T.DoubleType()))


def fit_forest(
    df: DataFrame, ids: Sequence[str], trees: int = 100, sample_size: int = 256, seed: int = 42, features: str = "features"
) -> Forest:
    """Draw ``sample_size`` rows per tree by hash rank and grow each tree in its own group."""
    rows = df.select(*[quoted(i) for i in ids], quoted(features).alias("x"))
    drawn = P.hash_picks(rows, ids, trees, sample_size, seed).select("draw", "h", "x")
    size = min(sample_size, df.count())
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        held = frame.sort_values("h").head(sample_size)
        t = int(frame["draw"].iloc[0])
        nodes = _grow(np.array(held["x"].tolist(), dtype=float), np.random.default_rng(seed + t), limit)
        return pd.DataFrame([(t, *nodes)], columns=["tree", "feature", "cut", "left", "right", "path"])

    grown = sorted(drawn.groupBy("draw").applyInPandas(grow, TREE_SCHEMA).collect(), key=lambda r: r["tree"])
    built = [
        (
            np.array(r["feature"], dtype=np.int64),
            np.array(r["cut"]),
            np.array(r["left"], dtype=np.int64),
            np.array(r["right"], dtype=np.int64),
            np.array(r["path"]),
        )
        for r in grown
    ]
    return Forest(built, average_path(size), limit)


def flag_outliers(
    df: DataFrame, ids: Sequence[str], contamination: float, trees: int = 100, sample_size: int = 256, seed: int = 42, features: str = "features"
) -> DataFrame:
    """Add ``anomaly`` and ``is_outlier``: scores above the ``1 - contamination`` quantile."""
    # Written once: the quantile takes several passes and scoring is the costly part.
    scored = cut_lineage(fit_forest(df, ids, trees, sample_size, seed, features).score(df, features))
    cut = exact_quantiles(scored.select("anomaly"), ["anomaly"], [1.0 - contamination])["anomaly"][0]
    return scored.withColumn("is_outlier", F.col("anomaly") > F.lit(cut))


def removal_counts(flagged: DataFrame) -> DataFrame:
    """``(n_before, n_removed, removed_pct)``."""
    return flagged.agg(F.count(F.lit(1)).alias("n_before"), F.count_if("is_outlier").alias("n_removed")).withColumn(
        "removed_pct", F.col("n_removed") * 100.0 / F.col("n_before")
    )
