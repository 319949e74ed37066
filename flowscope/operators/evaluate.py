"""Evaluation of predictions: per-class scores, confusion, ROC, log loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.functions.columns import quoted
from flowscope.operators.index import running_sums
from flowscope.session import cut_lineage


def class_scores(df: DataFrame, truth: str, predicted: str, classes: Sequence[str], beta: float = 2.0) -> DataFrame:
    """``(class, support, precision, recall, f1, fbeta)`` from one pass; 0 where undefined."""
    y, p = quoted(truth), quoted(predicted)
    counts = df.agg(
        *[
            F.struct(
                F.count_if((y == c) & (p == c)).alias("tp"),
                F.count_if(p == c).alias("flagged"),
                F.count_if(y == c).alias("support"),
            ).alias(f"c{i}")
            for i, c in enumerate(classes)
        ]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"c{i}").alias("m")) for i, c in enumerate(classes)])
    table = counts.select(F.inline(rows))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("m.tp", "m.flagged"), zero)
    recall = F.coalesce(F.try_divide("m.tp", "m.support"), zero)

    def f_score(b: float) -> Column:
        top = (1 + b * b) * F.col("precision") * F.col("recall")
        return F.coalesce(F.try_divide(top, b * b * F.col("precision") + F.col("recall")), zero)

    scored = table.withColumns({"precision": precision, "recall": recall})
    return scored.select(
        "class", F.col("m.support").alias("support"), "precision", "recall", f_score(1.0).alias("f1"), f_score(beta).alias("fbeta")
    )


def accuracy_pct(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(n, accuracy_pct)``."""
    hit = F.avg((quoted(truth) == quoted(predicted)).cast("double")) * 100
    return df.agg(F.count(F.lit(1)).alias("n"), hit.alias("accuracy_pct"))


def classification_report(df: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    per = class_scores(df, truth, predicted, classes).select("class", "precision", "recall", "f1", "support")
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), F.lit(0.0))

    summary = per.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"),
                weighted("recall").alias("precision"),
                weighted("recall").alias("recall"),
                weighted("recall").alias("f1"),
                total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"),
                F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"),
                F.avg("f1").alias("f1"),
                total.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                weighted("precision").alias("precision"),
                weighted("recall").alias("recall"),
                weighted("f1").alias("f1"),
                total.alias("support"),
            ),
        ).alias("r")
    )
    return per.unionByName(summary.select(F.inline("r")))


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """``(truth, predicted, n, share_pct)`` on the full label x label frame, zeros included."""
    spark = df.sparkSession
    counts = df.groupBy(quoted(truth).alias("truth"), quoted(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.createDataFrame([(t, p) for t in classes for p in classes], "truth string, predicted string")
    total = counts.agg(F.sum("n").alias("t")).scalar()
    full = frame.join(counts, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )
    return full.withColumn("share_pct", F.col("n") * 100.0 / total)


def binary_cells(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """``(cell, n, share_pct)`` with cells TN, FP, FN, TP."""
    counts = df.agg(
        F.count_if(~truth & ~predicted).alias("TN"),
        F.count_if(~truth & predicted).alias("FP"),
        F.count_if(truth & ~predicted).alias("FN"),
        F.count_if(truth & predicted).alias("TP"),
        F.count(F.lit(1)).alias("_n"),
    )
    return counts.unpivot("_n", ["TN", "FP", "FN", "TP"], "cell", "n").select(
        "cell", "n", F.try_divide(F.col("n") * 100.0, F.col("_n")).alias("share_pct")
    )


def roc_points(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """``(threshold, tp, fp, tpr, fpr)``, one row per distinct score, from high to low.

    Ties share a row, so the curve does not depend on row order; running sums are two-level. Rows
    without a finite score are left out.
    """
    counts = cut_lineage(
        df.select(C.finite_or_null(quoted(score).cast("double")).alias("threshold"), positive.alias("_y"))
        .filter(F.col("threshold").isNotNull())
        .groupBy("threshold")
        .agg(F.count_if("_y").alias("_pos"), F.count_if(~F.col("_y")).alias("_neg"))
    )
    totals = counts.agg(F.struct(F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))).scalar()
    sums = running_sums(counts, "threshold", {"tp": F.col("_pos"), "fp": F.col("_neg")}, descending=True)
    placed = sums.withColumn("_t", totals)
    return placed.select(
        "threshold",
        "_pos",
        "_neg",
        "tp",
        "fp",
        F.try_divide("tp", "_t.p").alias("tpr"),
        F.try_divide("fp", "_t.n").alias("fpr"),
    )


def roc_curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    return roc_points(df, score, positive).drop("_pos", "_neg")


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """``(positives, negatives, auc)``: area under the curve by trapezoids, ties at half weight."""
    points = roc_points(df, score, positive)
    # A trapezoid per distinct score: its negatives times the mean height before and after it.
    area = F.sum(F.col("_neg") * (F.col("tp") - F.col("_pos") / 2))
    return points.agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.try_divide(area, F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"),
    )


def micro_average_rows(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """Long ``(score, positive)`` rows over all classes, the input of a micro-averaged curve."""
    pairs = F.array(
        *[
            F.struct(quoted(col).cast("double").alias("score"), F.coalesce(quoted(truth) == cls, F.lit(False)).alias("positive"))
            for cls, col in scores.items()
        ]
    )
    return df.select(F.inline(pairs))


def log_loss(df: DataFrame, truth: Column, probability: Column, eps: float = 1e-15) -> DataFrame:
    """``(n, log_loss)`` with probabilities clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(probability, F.lit(eps)), F.lit(1 - eps))
    y = truth.cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss")
    )


def verdict(probability: Column, threshold: float = 0.5) -> Column:
    """``Block`` above the threshold, else ``Pass``."""
    return F.when(probability > threshold, "Block").otherwise("Pass")


def missed_by_both(first: DataFrame, second: DataFrame, truth: str, predicted: str, idx: str) -> DataFrame:
    """Rows of ``first`` that both prediction tables get wrong, matched by ``idx``."""
    wrong = lambda t: t.filter(quoted(truth) != quoted(predicted))
    return wrong(first).join(wrong(second).select(idx), idx, "left_semi")
