"""Distributions, cross-tabs, purity and phase reports.

Windows here run over already aggregated rows (one per label, cluster or phase).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.functions.columns import quoted

def distribution(df: DataFrame, column: str) -> DataFrame:
    """``(column, n, pct)``: counts and share of the table in percent, in no particular order."""
    counts = df.groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def share_within(
    df: DataFrame, outer: str, inner: str, only: Sequence[str] | None = None
) -> DataFrame:
    """``(outer, inner, n, pct)``: share of each inner value inside its outer value."""
    rows = df.filter(quoted(outer).isin(list(only))) if only is not None else df
    counts = rows.groupBy(quoted(outer), quoted(inner)).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(quoted(outer)))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def crosstab_pct(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised cross-tab in percent, one column per value."""
    counted = df.groupBy(quoted(row)).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(quoted(column) == v).alias(str(v)) for v in values],
    )
    return counted.select(quoted(row), *[(quoted(str(v)) * 100.0 / F.col("_n")).alias(str(v)) for v in values])


def cluster_verdicts(
    df: DataFrame, cluster: str, is_attack: Column, threshold: float = 0.8, noise: int = -1
) -> DataFrame:
    """Attack and benign counts per cluster, shares in percent and a verdict."""
    per = df.groupBy(quoted(cluster)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_attack).alias("attack"),
        F.count_if(~is_attack).alias("benign"),
    )
    attack_pct = F.col("attack") * 100.0 / F.col("total")
    benign_pct = F.col("benign") * 100.0 / F.col("total")
    verdict = (
        F.when(quoted(cluster) == noise, "noise")
        .when(F.col("attack_pct") > threshold * 100, "attack")
        .when(F.col("benign_pct") > threshold * 100, "benign")
        .otherwise("mixed")
    )
    return per.withColumns({"attack_pct": attack_pct, "benign_pct": benign_pct}).withColumn("verdict", verdict)


def purity(df: DataFrame, cluster: str, is_attack: Column) -> DataFrame:
    """Per cluster: counts, purity, its share of all attack and all benign rows, misassigned rows."""
    per = df.groupBy(quoted(cluster)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_attack).alias("attack"),
        F.count_if(~is_attack).alias("benign"),
    )
    return per.withColumns(
        {
            "purity": F.col("attack") / F.col("total"),
            "attack_share": F.try_divide(F.col("attack"), F.sum("attack").over(Window.partitionBy())),
            "benign_share": F.try_divide(F.col("benign"), F.sum("benign").over(Window.partitionBy())),
            "misassigned": F.least("attack", "benign"),
        }
    )


def high_purity_scores(purities: DataFrame, theta: float) -> DataFrame:
    """Over clusters of purity >= theta: recall, benign share inside them, true false-positive rate."""
    pure = F.col("purity") >= theta
    caught = F.coalesce(F.sum(F.when(pure, F.col("attack"))), F.lit(0))
    wrong = F.coalesce(F.sum(F.when(pure, F.col("benign"))), F.lit(0))
    return purities.agg(
        F.count_if(pure).alias("clusters"),
        caught.alias("attack_caught"),
        wrong.alias("benign_caught"),
        F.coalesce(F.try_divide(caught, F.sum("attack")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(wrong, caught + wrong), F.lit(0.0)).alias("benign_in_flagged"),
        F.coalesce(F.try_divide(wrong, F.sum("benign")), F.lit(0.0)).alias("false_positive_rate"),
    )


def traffic_aggregates(
    df: DataFrame, flag: str = "PSH Flag Count", lengths: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """Rows, share with the flag set and mean length; 0 where there are no rows or no such column."""
    have_flag = flag in df.columns
    length = next((c for c in lengths if c in df.columns), None)
    share = F.coalesce(F.avg((quoted(flag) > 0).cast("double")), F.lit(0.0)) if have_flag else F.lit(0.0)
    mean = F.coalesce(F.try_divide(F.sum(quoted(length)), F.count(quoted(length))), F.lit(0.0)) if length else F.lit(0.0)
    return df.groupBy(*[quoted(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n_flows"), share.alias("psh_share"), mean.alias("mean_length")
    )


def phase_means(
    windows: DataFrame, idx: str, phases: Mapping[str, tuple[int, int | None]], measures: Sequence[str]
) -> DataFrame:
    """Mean of each measure over named window ranges ``[start, end)``; ranges may overlap, and end open."""
    if not phases:
        raise ValueError("no phases given")
    hits = F.array_compact(
        F.array(
            *[F.when((F.col(idx) >= a) & (F.lit(True) if b is None else F.col(idx) < b), F.lit(name)) for name, (a, b) in phases.items()]
        )
    )
    return (
        windows.withColumn("phase", F.explode(hits))
        .groupBy("phase")
        .agg(F.count(F.lit(1)).alias("windows"), *[F.avg(quoted(m)).alias(m) for m in measures])
    )


def feature_bounds(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, lower, upper)`` from one pass."""
    wide = df.agg(
        *[
            F.struct(F.min(quoted(f)).cast("double").alias("lo"), F.max(quoted(f)).cast("double").alias("hi")).alias(f"b{i}")
            for i, f in enumerate(features)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"b{i}.lo").alias("lower"), F.col(f"b{i}.hi").alias("upper"))
            for i, f in enumerate(features)
        ]
    )
    return wide.select(F.inline(rows))


def class_guard(
    df: DataFrame, cluster: str, label: str, min_classes: int = 2, min_rows: int = 2
) -> DataFrame:
    """Per ``cluster``: number of classes, smallest class, distribution and whether it can be trained."""
    counts = df.groupBy(quoted(cluster).alias("cluster"), quoted(label).alias("_label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per = counts.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("classes"),
        F.min("n").alias("smallest"),
        F.sum("n").alias("rows"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("_label").cast("string"), "n")))).alias(
            "class_distribution"
        ),
    )
    status = (
        F.when(F.col("classes") < min_classes, "skipped: single class")
        .when(F.col("smallest") < min_rows, "skipped: class too small")
        .otherwise("trained")
    )
    return per.withColumn("status", status)
