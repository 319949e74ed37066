"""Rewards of clusterings against a label, threshold splits and purity routing.

All of it works on per-cluster counts ``(attack, benign)``, a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.functions.columns import quoted
from flowscope.operators.index import checked_broadcast, running_sums
from flowscope.session import cut_lineage


def purity_loss(
    attack: np.ndarray,
    total: np.ndarray,
    theta: float = 0.9,
    w_attack: float = 1.0,
    w_benign: float = 1.0,
    penalty: float = 1.0,
    graded: bool = True,
    min_share: float = 0.0,
) -> np.ndarray:
    """Loss per candidate from (P, K) counts, lower is better.

    Over clusters of purity >= theta the minimum of ``-w_attack d/N + w_benign b/(d+b)``. With none,
    ``penalty`` plus (``graded``) the gap to theta. A cluster under ``min_share`` of the rows costs
    ten penalties.
    """
    attack, total = np.atleast_2d(attack).astype(float), np.atleast_2d(total).astype(float)
    rows = total.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = np.where(total > 0, attack / total, 0.0)
        term = -w_attack * attack / rows + w_benign * np.where(total > 0, (total - attack) / total, 0.0)
    pure = (purity >= theta) & (total > 0)
    best = np.where(pure, term, np.inf).min(axis=1)
    missed = penalty + (theta - purity.max(axis=1) if graded else 0.0)
    loss = np.where(pure.any(axis=1), best, missed)
    if min_share > 0:
        tiny = (total < np.floor(min_share * rows)).any(axis=1)
        loss = np.where(tiny, 10 * penalty, loss)
    return loss


def purity_loss_table(
    clusters: DataFrame,
    theta: Column | float,
    w_attack: Column | float = 1.0,
    w_benign: Column | float = 1.0,
    penalty: float = 1.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """The same loss as an aggregate over rows ``(by..., attack, benign)``: ``(by..., loss)``."""
    rows = F.col("attack") + F.col("benign")
    totals = clusters.groupBy(*by).agg(F.sum(rows).alias("_n"))
    if by:
        joined = clusters.join(totals, list(by))
    else:
        joined = clusters.withColumn("_n", totals.scalar())
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    purity = F.try_divide(F.col("attack"), rows)
    term = -lit(w_attack) * F.col("attack") / F.col("_n") + lit(w_benign) * F.try_divide(F.col("benign"), rows)
    return joined.groupBy(*by).agg(
        F.coalesce(
            F.min(F.when(purity >= lit(theta), term)),
            F.lit(float(penalty)) + F.max(lit(theta)) - F.max(F.coalesce(purity, F.lit(0.0))),
        ).alias("loss")
    )


def reward_grid(clusters: DataFrame, grid: DataFrame, penalty: float = 10.0) -> DataFrame:
    """Loss of every parameter row ``(w_attack, w_benign, theta)`` on fixed cluster counts.

    The counts travel as one array to the parameter rows, so nothing is crossed.
    """
    cells = clusters.agg(F.collect_list(F.struct("attack", "benign"))).scalar()
    n = F.aggregate("_cells", F.lit(0).cast("bigint"), lambda acc, c: acc + c["attack"] + c["benign"])

    def loss(c: Column) -> Column:
        rows = c["attack"] + c["benign"]
        pure = F.try_divide(c["attack"], rows) >= F.col("theta")
        value = -F.col("w_attack") * c["attack"] / F.col("_n") + F.col("w_benign") * c["benign"] / rows
        return F.when(pure, value)

    scored = grid.withColumn("_cells", cells).withColumn("_n", n)
    best = F.array_min(F.array_compact(F.transform("_cells", loss)))
    return scored.withColumn("loss", F.coalesce(best, F.lit(penalty))).drop("_cells", "_n")


def weighted_recall(clusters: DataFrame, grid: DataFrame, theta: float = 0.9) -> DataFrame:
    """``w_recall * recall - w_benign * benign share`` of the clusters of purity >= theta, per grid row."""
    pure = F.try_divide(F.col("attack"), F.col("attack") + F.col("benign")) >= theta
    caught, wrong = F.sum(F.when(pure, F.col("attack"))), F.sum(F.when(pure, F.col("benign")))
    stats = clusters.agg(
        F.struct(
            F.coalesce(F.try_divide(caught, F.sum("attack")), F.lit(0.0)).alias("recall"),
            F.coalesce(F.try_divide(wrong, caught + wrong), F.lit(0.0)).alias("benign"),
        )
    ).scalar()
    scored = grid.withColumn("_s", stats)
    objective = F.col("w_recall") * F.col("_s.recall") - F.col("w_benign") * F.col("_s.benign")
    return scored.withColumn("objective", objective).drop("_s")


def route_by_purity(
    df: DataFrame, purities: DataFrame, cluster: str, theta: float, name: str = "route"
) -> DataFrame:
    """Rows of clusters with purity >= theta get their verdict, the rest goes to stage two."""
    verdict = F.when(F.col("purity") >= theta, "block").when(1 - F.col("purity") >= theta, "pass").otherwise("stage2")
    routes = purities.select(quoted(cluster).alias("_k"), verdict.alias(name))
    joined = df.join(checked_broadcast(routes), quoted(cluster).eqNullSafe(F.col("_k")), "left").drop("_k")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit("stage2")))


def best_label_split(df: DataFrame, value: str, is_attack: Column) -> DataFrame:
    """The threshold on one column that disagrees least with the label, exactly.

    ``(threshold, attack_above, errors, n)``: rows above the threshold form one cluster. Every cut
    between distinct values and both orientations are compared by running sums over value counts.
    Rows without a finite value are left out.
    """
    x = C.finite_or_null(quoted(value).cast("double"))
    counts = cut_lineage(
        df.select(x.alias("x"), is_attack.alias("a"))
        .filter(F.col("x").isNotNull())
        .groupBy("x")
        .agg(F.count_if("a").alias("attack"), F.count_if(~F.col("a")).alias("benign"))
    )
    sums = running_sums(counts, "x", {"ca": F.col("attack"), "cb": F.col("benign")})
    total = counts.agg(F.struct(F.sum("attack").alias("a"), F.sum("benign").alias("b"))).scalar()
    t = sums.withColumn("_t", total)
    # Attack above the cut: errors are attack rows at or below it and benign rows above it.
    above = F.col("ca") + F.col("_t.b") - F.col("cb")
    below = F.col("cb") + F.col("_t.a") - F.col("ca")
    options = F.array(
        F.struct(above.alias("errors"), F.col("x").alias("threshold"), F.lit(True).alias("attack_above")),
        F.struct(below.alias("errors"), F.col("x").alias("threshold"), F.lit(False).alias("attack_above")),
    )
    return (
        t.select(F.array_min(options).alias("o"), (F.col("_t.a") + F.col("_t.b")).alias("n"))
        .agg(F.min("o").alias("o"), F.max("n").alias("n"))
        .select("o.threshold", "o.attack_above", "o.errors", "n")
    )
