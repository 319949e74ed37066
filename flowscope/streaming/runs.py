"""Starting, draining and timing streams; time windows; two-stage verdicts."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from flowscope.functions import entropy as E
from flowscope.functions.columns import quoted
from flowscope.operators.evaluate import verdict
from flowscope.operators.reward import route_by_purity
from flowscope.session import scratch_path

PROGRESS_SCHEMA = (
    "batch bigint, rows bigint, trigger_ms bigint, add_batch_ms bigint, ms_per_row double, rows_per_ms double"
)


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def drain(stream: DataFrame, name: str, mode: str = "append", sink: str | None = None, state: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over everything available now into Parquet and read that back.

    With the same ``sink`` and ``state`` folders a later run goes on where this one ended.
    """
    spark = stream.sparkSession
    out, state = sink or scratch_path(spark, name), state or scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


class BatchLog(StreamingQueryListener):
    """Progress of every micro-batch of the queries that run while it listens (one tuple a batch)."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], tuple] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        n, spent = int(p.numInputRows), p.durationMs
        total = int(spent.get("triggerExecution", 0))
        self.batches[str(p.runId), int(p.batchId)] = (
            int(p.batchId), n, total, int(spent.get("addBatch", 0)), total / n if n else None, n / total if total else None
        )

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))

    def of(self, query: StreamingQuery, patience: float = 30.0) -> list[tuple]:
        """All batches of an ended query; progress arrives a little later than the end."""
        run, until = str(query.runId), time.monotonic() + patience
        while run not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return [row for (r, _), row in sorted(self.batches.items()) if r == run]


def logged(spark: SparkSession, run: Callable[[], tuple[DataFrame, StreamingQuery]]) -> tuple[DataFrame, DataFrame]:
    """Run a stream to its end; its output, and latency and throughput of every micro-batch."""
    log = BatchLog()
    spark.streams.addListener(log)
    try:
        out, query = run()
        return out, spark.createDataFrame(log.of(query), PROGRESS_SCHEMA)
    finally:
        spark.streams.removeListener(log)


def amortised_cost(batches: DataFrame, cluster_ms: float, batch_size: float) -> DataFrame:
    """``(rows, ms_per_row, amortised_ms)``: cost per row plus the clustering share of each row."""
    return batches.agg(
        F.sum("rows").alias("rows"), F.try_divide(F.sum("trigger_ms"), F.sum("rows")).alias("ms_per_row")
    ).withColumn("amortised_ms", F.col("ms_per_row") + F.lit(cluster_ms / batch_size))


def time_window_entropy(
    df: DataFrame,
    time: str,
    value: str,
    width: str,
    metrics: Sequence[str] = ("shannon", "renyi_2", "min_entropy"),
    slide: str | None = None,
    delay: str | None = None,
) -> DataFrame:
    """Entropies of a value per time window: ``(start, end, n, metrics...)``, batch or stream.

    A stream needs ``delay``, its watermark; it then emits the windows the watermark has passed.
    """
    E.check_metrics(metrics)
    rows = df.select(quoted(time).cast("timestamp").alias("_t"), quoted(value).alias("_v")).filter(F.col("_v").isNotNull())
    if delay:
        rows = rows.withWatermark("_t", delay)
    window = F.window("_t", width, slide or width)
    counts = rows.groupBy(window.alias("_w"), "_v").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupBy("_w")
        .agg(F.sum("n").alias("total"), *[E.COUNT_METRICS[m](F.col("n")).alias(m) for m in metrics])
        .select(
            F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), F.col("total").alias("n"),
            *[quoted(m) for m in metrics],
        )
    )


def two_stage_verdict(
    rows: DataFrame,
    assign: Callable[[DataFrame], DataFrame],
    purities: DataFrame,
    theta: float,
    classifier: PipelineModel,
    attack_index: int,
    cluster: str = "cluster",
    threshold: float = 0.5,
) -> DataFrame:
    """Verdict of every row, batch or stream: pure clusters decide, the classifier takes the rest.

    Adds ``route`` and ``verdict`` (Block or Pass).
    """
    routed = route_by_purity(assign(rows), purities, cluster, theta)
    scored = classifier.transform(routed)
    p = vector_to_array("probability")[attack_index]
    final: Column = (
        F.when(F.col("route") == "block", "Block").when(F.col("route") == "pass", "Pass").otherwise(verdict(p, threshold))
    )
    return scored.select(*routed.columns, final.alias("verdict"))
