"""Work on a stream in batches of a fixed number of rows, whatever its triggers bring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowscope.functions.columns import quoted
from flowscope.operators.index import with_row_index
from flowscope.session import scratch_path

SIZE = 1024
# The trigger under which the rows after the last full batch come out.
REST = -1


def batches_by_count(
    stream: DataFrame,
    work: Callable[[pd.DataFrame], pd.DataFrame],
    added: T.StructType,
    order: Sequence[str],
    size: int = SIZE,
    sink: str | None = None,
    state: str | None = None,
    flush: bool = True,
) -> tuple[DataFrame, StreamingQuery]:
    """Rows of a stream with ``batch`` and the columns ``added`` that ``work`` gives to each full batch.

    Rows are numbered in the order of their triggers, inside a trigger by ``order``. Those after the last full batch wait in
    a table for the next trigger; a trigger that brings several batches works on them side by side, one per task. With
    ``flush`` the rows that are left at the end come out as one short batch, which a later run over more rows takes back.

    ``sink`` and ``state`` name the folders of results and progress: a stream started again with the same ones goes on
    where it stopped. A trigger that runs again overwrites what it wrote.
    """
    spark = stream.sparkSession
    sink, state = sink or scratch_path(spark, "batches"), state or scratch_path(spark, "batches-state")
    columns = stream.columns
    waiting = T.StructType([*stream.schema.fields]).add("_at", T.LongType())
    schema = T.StructType([*stream.schema.fields, *added.fields]).add("batch", T.LongType())

    def worked(rows: DataFrame) -> DataFrame:
        def one(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("_pos")
            out = work(frame[columns])
            out["batch"] = frame["batch"].to_numpy()
            return out[[f.name for f in schema]]

        return rows.groupBy("batch").applyInPandas(one, schema)

    def handle(batch: DataFrame, trigger: int) -> None:
        # The stream's own session may differ from the caller's.
        own = batch.sparkSession
        fresh, first = batch.withColumn("_at", F.lit(0).cast("long")).withColumn("_new", F.lit(1)), 0
        if trigger > 0:
            kept = own.read.schema(waiting).parquet(f"{sink}/waiting/trigger={trigger - 1}")
            fresh = kept.withColumn("_new", F.lit(0)).unionByName(fresh)
            first = own.read.parquet(f"{sink}/next/trigger={trigger - 1}").first()["next"]
        placed = with_row_index(fresh, ["_new", "_at", *order], "_pos", unique=True)
        full = placed.count() // size
        done = placed.filter(F.col("_pos") < full * size).withColumn("batch", F.lit(first) + F.expr(f"_pos div {int(size)}"))
        worked(done.drop("_at", "_new")).write.mode("overwrite").parquet(f"{sink}/out/trigger={trigger}")
        rest = placed.filter(F.col("_pos") >= full * size).select(*map(quoted, columns), F.col("_pos").alias("_at"))
        rest.coalesce(1).write.mode("overwrite").parquet(f"{sink}/waiting/trigger={trigger}")
        own.createDataFrame([(first + full,)], "next long").coalesce(1).write.mode("overwrite").parquet(f"{sink}/next/trigger={trigger}")

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # A stream that has brought no row at all has written nothing.
    written = spark.read.schema(T.StructType().add("next", T.LongType()).add("trigger", T.LongType())).option("basePath", f"{sink}/next")
    spark.createDataFrame([], "next long").write.mode("ignore").parquet(f"{sink}/next/trigger={REST}")
    last = written.parquet(f"{sink}/next").orderBy(F.desc("trigger")).first()
    rest = spark.createDataFrame([], waiting) if last is None else spark.read.schema(waiting).parquet(f"{sink}/waiting/trigger={last['trigger']}")
    if not flush:
        rest = rest.limit(0)
    numbered = rest.withColumnRenamed("_at", "_pos").withColumn("batch", F.lit(last["next"] if last else 0).cast("long"))
    worked(numbered).write.mode("overwrite").parquet(f"{sink}/out/trigger={REST}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sink}/out"), query


def standardised(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)


def mixture_labels(x: np.ndarray, k: int, steps: int = 100, tolerance: float = 1e-3, ridge: float = 1e-6) -> np.ndarray:
    """Components of a full-covariance mixture of standardised rows; it starts from k-means over rows far apart."""
    n, d = x.shape
    picked = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    while len(picked) < k:
        picked.append(int(np.min([((x - x[p]) ** 2).sum(1) for p in picked], axis=0).argmax()))
    centers = x[picked]
    for _ in range(20):
        near = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.stack([x[near == j].mean(0) if (near == j).any() else centers[j] for j in range(k)])
    share = np.eye(k)[near]
    before = -np.inf
    for _ in range(steps):
        weight = share.sum(0) + 10 * np.finfo(float).eps
        mean = share.T @ x / weight[:, None]
        log_p = np.empty((n, k))
        for j in range(k):
            apart = x - mean[j]
            factor = np.linalg.cholesky((share[:, j, None] * apart).T @ apart / weight[j] + ridge * np.eye(d))
            scaled = np.linalg.solve(factor, apart.T)
            log_p[:, j] = np.log(weight[j] / n) - (scaled**2).sum(0) / 2 - np.log(np.diag(factor)).sum() - d * np.log(2 * np.pi) / 2
        top = log_p.max(1, keepdims=True)
        total = top + np.log(np.exp(log_p - top).sum(1, keepdims=True))
        share, now = np.exp(log_p - total), float(total.mean())
        if abs(now - before) < tolerance:
            break
        before = now
    return log_p.argmax(1)


def cluster_stream(
    stream: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    k: int = 2,
    size: int = SIZE,
    sink: str | None = None,
    state: str | None = None,
    flush: bool = True,
) -> tuple[DataFrame, StreamingQuery]:
    """Standardise and cluster a stream ``size`` rows at a time, each batch by itself.

    Rows without a finite value in a feature, and those of a batch with fewer than ``k`` others, have no cluster.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[list(features)].to_numpy(dtype=float)
        usable = np.isfinite(x).all(axis=1)
        labels = pd.array([pd.NA] * len(frame), dtype="Int32")
        if usable.sum() >= max(2, k):
            labels[usable] = mixture_labels(standardised(x[usable]), k)
        return frame.assign(cluster=labels)

    return batches_by_count(stream, work, T.StructType().add("cluster", T.IntegerType()), order, size, sink, state, flush)
