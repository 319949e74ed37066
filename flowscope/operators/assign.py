"""Distances from rows to sets of centroids, and the sums that follow from them.

Rows carry ``features: array<double>``. Tasks work on Arrow batches with matrix products and emit a
few sums per (candidate, cluster); Spark combines those. Nothing row-sized reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.functions.columns import quoted

# Centroid numbers shipped to every task; keeps a population a small broadcast.
MAX_CENTROID_NUMBERS = 20_000_000
# Numbers held at once inside a task, so many as stay in a core's cache; and rows at least.
BLOCK = 65_536
LEAST_ROWS = 1_024
# Clusters up to which marks of all of them are less work than a search of the least distance in each row.
FEW = 16


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(len(column), -1)


def blocks(x: np.ndarray, width: int) -> Iterator[slice]:
    step = max(LEAST_ROWS, BLOCK // max(1, width))
    for start in range(0, len(x), step):
        yield slice(start, start + step)


PACKED = ["_x", "_y"]


def pack(df: DataFrame, features: str = "features", label: str | None = None) -> DataFrame:
    """Rows as blocks of raw numbers, which tasks read without a step per row; what scores populations takes them for rows.

    A row without a label is no attack.
    """
    rows = df.select(quoted(features).alias("x"), (quoted(label).cast("int") if label else F.lit(0)).alias("y"))

    def raw(batches):
        for x, y in matrices(batches, False):
            columns = [pa.array([x.tobytes()], pa.binary()), pa.array([np.nan_to_num(y.astype(np.float64)).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=PACKED)

    return rows.mapInArrow(raw, "_x binary, _y binary")


def is_packed(df: DataFrame) -> bool:
    return df.columns == PACKED


def matrices(batches, packed: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, dims) features and labels of every block, or of every batch of plain rows ``(x, y)``."""
    for batch in batches:
        if packed:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                labels = np.frombuffer(y.as_buffer())
                yield np.frombuffer(x.as_buffer()).reshape(len(labels), -1), labels
        elif batch.num_rows:
            yield matrix_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)


def relabelled(data: DataFrame, label: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Packed rows with other labels."""

    def run(batches):
        for x, _ in matrices(batches, True):
            labels = np.concatenate([np.empty(0), *(label(x[part]) for part in blocks(x, BLOCK // LEAST_ROWS))])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([labels.astype(np.float64).tobytes()], pa.binary())], names=PACKED)

    return data.mapInArrow(run, "_x binary, _y binary")


def nearest_labels(data: DataFrame, centroids: np.ndarray, groups: np.ndarray | None = None) -> DataFrame:
    """Packed rows with their nearest centroid, or its group, as their label."""
    fixed = np.asarray(centroids, dtype=np.float64)
    columns = np.hstack([-2.0 * fixed, np.einsum("ij,ij->i", fixed, fixed)[:, None]]).T
    names = np.arange(len(fixed)) if groups is None else groups
    return relabelled(data, lambda x: names[(np.column_stack([x, np.ones(len(x))]) @ columns).argmin(axis=1)])


def label_moments(data: DataFrame, k_count: int, dims: int) -> dict[str, np.ndarray]:
    """Sums of packed rows by their labels 0..K-1, as of one candidate."""

    def sums(batches):
        found = np.zeros((k_count, 2 + dims))
        for x, y in matrices(batches, True):
            labels = y.astype(np.int64)
            for c, w in enumerate((np.ones(len(x)), np.einsum("ij,ij->i", x, x), *x.T)):
                found[:, c] += np.bincount(labels, weights=w, minlength=k_count)
        here = np.flatnonzero(found[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(here.astype(np.int32)), pa.array(list(found[here]), type=pa.list_(pa.float64()))], names=["cluster", "sums"]
        )

    total = data.mapInArrow(sums, "cluster int, sums array<double>").groupBy("cluster").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    out = np.zeros((1, k_count, 2 + dims))
    for row in total.collect():
        out[0, row["cluster"]] = row["sums"]
    return {"n": np.rint(out[:, :, 0]).astype(np.int64), "sum_sq": out[:, :, 1], "sums": out[:, :, 2:]}


def first_least(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (P, K, rows) the first least along K, as marks 0.0 and 1.0, and its value (P, rows)."""
    least = d.min(axis=1)
    marks, free = np.empty(d.shape), np.ones(least.shape, dtype=bool)
    for k in range(d.shape[1]):
        here = (d[:, k] == least) & free
        free ^= here
        marks[:, k] = here
    return marks, least


def marked(x: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of the nearest centroid in every set (P, K, rows), the squared distance to it (P, rows), squared norms of the rows."""
    p_count, k_count, dims = sets.shape
    flat = sets.reshape(-1, dims)
    own = np.einsum("ij,ij->i", x, x)
    d = np.hstack([-2.0 * flat, np.einsum("ij,ij->i", flat, flat)[:, None]]) @ np.vstack([x.T, np.ones(len(x))])
    marks, least = first_least(d.reshape(p_count, k_count, len(x)))
    return marks, np.maximum(least + own, 0.0), own


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows, K) squared Euclid distances, by differences so that equal distances stay equal."""
    out = np.empty((len(x), len(centroids)))
    for k, c in enumerate(centroids):
        diff = x - c
        out[:, k] = np.einsum("ij,ij->i", diff, diff)
    return out


def check_size(centroids: np.ndarray) -> None:
    if centroids.size > MAX_CENTROID_NUMBERS:
        raise ValueError("too many centroids for one pass; split the population")


def nearest(
    df: DataFrame,
    centroids: np.ndarray,
    features: str = "features",
    cluster: str = "cluster",
    distance: str = "distance",
) -> DataFrame:
    """Add the nearest centroid (lowest index wins a tie) and the Euclid distance to it."""
    fixed = np.asarray(centroids, dtype=np.float64)
    check_size(fixed)
    df = df.drop(cluster, distance)
    names = list(df.columns)
    at = names.index(features)

    def assign(batches):
        for batch in batches:
            x = matrix_of(batch.column(at)) if batch.num_rows else np.empty((0, fixed.shape[1]))
            labels = np.empty(len(x), dtype=np.int32)
            away = np.empty(len(x))
            for part in blocks(x, fixed.size):
                d = squared_distances(x[part], fixed)
                labels[part] = d.argmin(axis=1)
                away[part] = np.sqrt(d.min(axis=1))
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(labels), pa.array(away)], names=[*names, cluster, distance]
            )

    schema = T.StructType([*df.schema.fields])
    schema = schema.add(cluster, T.IntegerType()).add(distance, T.DoubleType())
    return df.mapInArrow(assign, schema)


MOMENT_SCHEMA = (
    "candidate int, cluster int, n bigint, attack bigint, inertia double, sum_sq double, sums array<double>"
)


def candidate_moments(
    df: DataFrame, population: np.ndarray, features: str = "features", label: str | None = None
) -> DataFrame:
    """Label all rows by every candidate of ``population`` (P, K, D) in one job.

    ``(candidate, cluster, n, attack, inertia, sum_sq, sums)`` per non-empty cluster.
    """
    sets = np.asarray(population, dtype=np.float64)
    check_size(sets)
    p_count, k_count, dims = sets.shape
    flat = sets.reshape(-1, dims)
    norms = np.einsum("ij,ij->i", flat, flat)
    columns = np.hstack([-2.0 * flat, norms[:, None]]).T
    packed, known = is_packed(df), bool(np.isfinite(flat).all())
    rows = df if packed else df.select(quoted(features).alias("x"), (quoted(label).cast("int") if label else F.lit(0)).alias("y"))

    def sums(batches):
        n = np.zeros((p_count, k_count), dtype=np.int64)
        attack = np.zeros_like(n)
        inertia = np.zeros((p_count, k_count))
        sum_sq = np.zeros((p_count, k_count))
        total = np.zeros((p_count, k_count, dims))
        for x_all, y_all in matrices(batches, packed):
            for part in blocks(x_all, p_count * k_count):
                x, y = x_all[part], y_all[part]
                finite = known and np.isfinite(x).all() and np.isfinite(y).all()
                if finite and k_count > FEW:
                    own, place = np.einsum("ij,ij->i", x, x), np.arange(len(x))
                    d = np.column_stack([x, np.ones(len(x))]) @ columns
                    for p in range(p_count):
                        mine = d[:, p * k_count : (p + 1) * k_count]
                        lab = mine.argmin(axis=1)
                        count = lambda w: np.bincount(lab, weights=w, minlength=k_count)  # noqa: B023, E731
                        n[p] += np.bincount(lab, minlength=k_count)
                        attack[p] += np.rint(count(y)).astype(np.int64)
                        inertia[p] += count(np.maximum(mine[place, lab] + own, 0.0))
                        sum_sq[p] += count(own)
                        total[p] += np.column_stack([count(v) for v in x.T])
                    continue
                if finite:
                    marks, least, own = marked(x, sets)
                    found = marks.reshape(-1, len(x)) @ np.column_stack([np.ones(len(x)), y, own, x])
                    found = found.reshape(p_count, k_count, -1)
                    n += np.rint(found[:, :, 0]).astype(np.int64)
                    attack += np.rint(found[:, :, 1]).astype(np.int64)
                    inertia += (marks @ least[:, :, None])[:, :, 0]
                    sum_sq += found[:, :, 2]
                    total += found[:, :, 3:]
                    continue
                # Rows or centroids that are not finite touch their own cluster only.
                own = np.einsum("ij,ij->i", x, x)
                d = (own[:, None] + norms[None, :] - 2.0 * (x @ flat.T)).reshape(len(x), p_count, k_count)
                labels = d.argmin(axis=2)
                away = np.maximum(np.take_along_axis(d, labels[:, :, None], axis=2)[:, :, 0], 0.0)
                for p in range(p_count):
                    lab = labels[:, p]
                    n[p] += np.bincount(lab, minlength=k_count)
                    attack[p] += np.bincount(lab, weights=y, minlength=k_count).astype(np.int64)
                    inertia[p] += np.bincount(lab, weights=away[:, p], minlength=k_count)
                    sum_sq[p] += np.bincount(lab, weights=own, minlength=k_count)
                    hot = (lab[:, None] == np.arange(k_count)).astype(np.float64)
                    total[p] += hot.T @ x
        filled = np.argwhere(n > 0)
        if len(filled):
            p, k = filled[:, 0], filled[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p.astype(np.int32)),
                    pa.array(k.astype(np.int32)),
                    pa.array(n[p, k]),
                    pa.array(attack[p, k]),
                    pa.array(inertia[p, k]),
                    pa.array(sum_sq[p, k]),
                    pa.array(list(total[p, k]), type=pa.list_(pa.float64())),
                ],
                names=["candidate", "cluster", "n", "attack", "inertia", "sum_sq", "sums"],
            )

    partial = rows.mapInArrow(sums, MOMENT_SCHEMA)
    return (
        partial.groupBy("candidate", "cluster")
        .agg(
            F.sum("n").alias("n"),
            F.sum("attack").alias("attack"),
            F.sum("inertia").alias("inertia"),
            F.sum("sum_sq").alias("sum_sq"),
            Summarizer.sum(array_to_vector("sums")).alias("_sums"),
        )
        .withColumn("sums", vector_to_array("_sums"))
        .drop("_sums")
    )


SHAPE_SCHEMA = "candidate int, cluster int, n bigint, sum_dist double, sum_silhouette double"


def _shape_sums(x, labels, n, sums, sum_sq):
    """Per cluster: rows, sum of distances to its mean, sum of squared-Euclid silhouettes."""
    k_count = len(n)
    filled = np.flatnonzero(n > 0)
    means = sums[filled] / n[filled, None]
    own = np.einsum("ij,ij->i", x, x)
    # Mean squared distance from a row to all rows of a cluster, in closed form.
    spread = own[:, None] + (sum_sq[filled] / n[filled])[None, :] - 2.0 * (x @ means.T)
    place = np.full(k_count, -1)
    place[filled] = np.arange(len(filled))
    mine = place[labels]
    rows = np.arange(len(x))
    size = n[labels].astype(np.float64)
    a = spread[rows, mine] * size / np.maximum(size - 1.0, 1.0)
    others = spread.copy()
    others[rows, mine] = np.inf
    b = others.min(axis=1)
    top = np.maximum(a, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.where((size > 1) & np.isfinite(b) & (top > 0), (b - a) / top, 0.0)
    diff = x - means[mine]
    away = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return (
        np.bincount(labels, minlength=k_count),
        np.bincount(labels, weights=away, minlength=k_count),
        np.bincount(labels, weights=s, minlength=k_count),
    )


def _marked_shapes(x, marks, own, n, means, sum_sq):
    """The same sums for finite rows and all candidates at once: (P, K) each, from the marks (P, K, rows) of the clusters."""
    p_count, k_count, dims = means.shape
    size = np.maximum(n, 1).astype(np.float64)
    square = sum_sq / size
    to_means = (-2.0 * means.reshape(-1, dims) @ x.T).reshape(p_count, k_count, len(x))
    # Size, mean square and squared norm of the mean of every row's own cluster.
    norm = np.einsum("pkd,pkd->pk", means, means)
    sizes, squares, norms = (np.stack([n, square, norm], axis=1).astype(np.float64) @ marks).transpose(1, 0, 2)
    others = np.where(n > 0, square, np.inf)
    mine, b = np.zeros((p_count, len(x))), np.full((p_count, len(x)), np.inf)
    for k in range(k_count):
        mine += to_means[:, k] * marks[:, k]
        np.minimum(b, np.where(marks[:, k] > 0, np.inf, to_means[:, k] + others[:, k, None]), out=b)
    a = (own + squares + mine) * sizes / np.maximum(sizes - 1.0, 1.0)
    b += own
    top = np.maximum(a, b)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.where((sizes > 1) & np.isfinite(b) & (top > 0), (b - a) / top, 0.0)
    away = own + norms + mine
    # Close to the mean the difference of large numbers says little.
    p, i = np.nonzero(away < 1e-6 * (own + norms))
    if len(p):
        away[p, i] = ((x[i] - means[p, marks[p, :, i].argmax(axis=1)]) ** 2).sum(axis=1)
    away = np.sqrt(np.maximum(away, 0.0))
    found = marks @ np.stack([np.ones_like(s), away, s], axis=2)
    return np.rint(found[:, :, 0]).astype(np.int64), found[:, :, 1], found[:, :, 2]


def _shape_batches(parts, p_count, k_count, n, sums, sum_sq):
    """``parts`` brings rows with marks and squared norms, or with labels (rows, P) where something is not finite."""
    rows = np.zeros((p_count, k_count), dtype=np.int64)
    dist = np.zeros((p_count, k_count))
    sil = np.zeros((p_count, k_count))
    means = sums / np.maximum(n, 1)[:, :, None]
    for x, marks, own, labels in parts:
        if marks is not None:
            r, d, s = _marked_shapes(x, marks, own, n, means, sum_sq)
            rows, dist, sil = rows + r, dist + d, sil + s
            continue
        for p in range(p_count):
            r, d, s = _shape_sums(x, labels[:, p], n[p], sums[p], sum_sq[p])
            rows[p] += r
            dist[p] += d
            sil[p] += s
    filled = np.argwhere(rows > 0)
    if len(filled):
        p, k = filled[:, 0], filled[:, 1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(p.astype(np.int32)),
                pa.array(k.astype(np.int32)),
                pa.array(rows[p, k]),
                pa.array(dist[p, k]),
                pa.array(sil[p, k]),
            ],
            names=["candidate", "cluster", "n", "sum_dist", "sum_silhouette"],
        )


def _reduced_shapes(partial: DataFrame) -> DataFrame:
    return partial.groupBy("candidate", "cluster").agg(
        F.sum("n").alias("n"), F.sum("sum_dist").alias("sum_dist"), F.sum("sum_silhouette").alias("sum_silhouette")
    )


def candidate_shapes(
    df: DataFrame, population: np.ndarray, n: np.ndarray, sums: np.ndarray, sum_sq: np.ndarray, features: str = "features"
) -> DataFrame:
    """Second pass of the scores: distances to the cluster means and silhouettes, all candidates."""
    sets = np.asarray(population, dtype=np.float64)
    check_size(sets)
    p_count, k_count, dims = sets.shape
    flat = sets.reshape(-1, dims)
    norms = np.einsum("ij,ij->i", flat, flat)

    packed = is_packed(df)
    known = bool(np.isfinite(flat).all() and np.isfinite(sums).all() and np.isfinite(sum_sq).all())

    def shapes(batches):
        def parts():
            for x_all, _ in matrices(batches, packed):
                for part in blocks(x_all, p_count * k_count):
                    x = x_all[part]
                    if known and k_count <= FEW and np.isfinite(x).all():
                        marks, _, own = marked(x, sets)
                        yield x, marks, own, None
                        continue
                    own = np.einsum("ij,ij->i", x, x)
                    d = own[:, None] + norms[None, :] - 2.0 * (x @ flat.T)
                    yield x, None, None, d.reshape(len(x), p_count, k_count).argmin(axis=2)

        yield from _shape_batches(parts(), p_count, k_count, n, sums, sum_sq)

    rows = df if packed else df.select(quoted(features).alias("x"), F.lit(0).alias("y"))
    return _reduced_shapes(rows.mapInArrow(shapes, SHAPE_SCHEMA))


def labelled_shapes(
    df: DataFrame, cluster: str, n: np.ndarray, sums: np.ndarray, sum_sq: np.ndarray, features: str = "features"
) -> DataFrame:
    """The same sums for a table that already has cluster codes 0..K-1 in ``cluster``, or as the labels of its blocks."""
    k_count, packed = len(n), is_packed(df)

    def shapes(batches):
        def parts():
            for x_all, codes in matrices(batches, packed):
                for part in blocks(x_all, k_count):
                    yield x_all[part], None, None, codes[part].astype(np.int64).reshape(-1, 1)

        yield from _shape_batches(parts(), 1, k_count, n[None], sums[None], sum_sq[None])

    rows = df if packed else df.select(quoted(features).alias("x"), quoted(cluster).cast("int").alias("c"))
    return _reduced_shapes(rows.mapInArrow(shapes, SHAPE_SCHEMA))


def dimensions(df: DataFrame, features: str = "features") -> int:
    return df.select(F.size(quoted(features))).first()[0]


def first_dimensions(df: DataFrame, features: str = "features") -> int:
    return len(df.select(quoted(features)).first()[0])


def to_arrays(moments: DataFrame, p_count: int, k_count: int, dims: int) -> dict[str, np.ndarray]:
    """Collect per-cluster sums (at most P x K rows) into arrays."""
    out = {
        "n": np.zeros((p_count, k_count), dtype=np.int64),
        "attack": np.zeros((p_count, k_count), dtype=np.int64),
        "inertia": np.zeros((p_count, k_count)),
        "sum_sq": np.zeros((p_count, k_count)),
        "sums": np.zeros((p_count, k_count, dims)),
    }
    for row in moments.collect():
        at = (row["candidate"], row["cluster"])
        for key in out:
            out[key][at] = row[key]
    return out
