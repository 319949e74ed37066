"""Writing results: exports per cluster, misclassified rows, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions.columns import quoted


def export_cluster_sides(df: DataFrame, label: str, value: str, path: str) -> None:
    """Positive and complement rows of one local cluster in one write: ``side=positive|complement``."""
    side = F.when(quoted(label) == value, "positive").otherwise("complement")
    df.withColumn("side", side).write.mode("overwrite").partitionBy("side").parquet(path)


def misclassified(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """False negatives and false positives with their ``kind``."""
    kind = F.when(truth & ~predicted, "FN").when(~truth & predicted, "FP")
    return df.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def export_misclassified(df: DataFrame, truth: Column, predicted: Column, path: str) -> None:
    """One CSV folder per kind."""
    misclassified(df, truth, predicted).write.mode("overwrite").partitionBy("kind").option("header", "true").csv(path)


def run_summary(model: str, clusters: DataFrame, metrics: DataFrame | None = None, key: str = "cluster") -> DataFrame:
    """One JSON document per model: ``(model, run_at, summary)`` with cluster status and metrics."""
    rows = clusters.join(metrics, key, "left") if metrics is not None else clusters
    packed = F.struct(*[quoted(c) for c in rows.columns])
    by_key = lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
    return rows.agg(F.array_sort(F.collect_list(packed), by_key).alias("clusters")).select(
        F.lit(model).alias("model"),
        F.current_timestamp().alias("run_at"),
        F.to_json(F.struct(F.lit(model).alias("model"), "clusters")).alias("summary"),
    )


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
