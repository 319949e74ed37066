"""Distribution metrics of columns: value counts, profiles and feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions import entropy as E
from flowscope.functions.columns import quoted
from flowscope.operators.index import checked_broadcast


def unpivot_features(df: DataFrame, by: Sequence[str], features: Sequence[str], as_type: str) -> DataFrame:
    """Long form ``(by..., feature, value)`` without nulls."""
    casted = df.select(*[quoted(b) for b in by], *[quoted(f).cast(as_type).alias(f) for f in features])
    long = casted.unpivot(
        [quoted(b) for b in by], [quoted(f) for f in features], "feature", "value"
    )
    return long.filter(F.col("value").isNotNull())


def value_counts(
    df: DataFrame, by: Sequence[str], features: Sequence[str], as_type: str = "double"
) -> DataFrame:
    """``(by..., feature, value, n)``; a hot value shrinks to one row per task before the shuffle."""
    long = unpivot_features(df, by, features, as_type)
    return long.groupBy(*[quoted(b) for b in by], "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def count_entropies(counts: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Entropies per group of a count table; only the named metrics are computed."""
    E.check_metrics(metrics)
    return counts.groupBy(*[quoted(b) for b in by]).agg(
        *[E.COUNT_METRICS[m](F.col("n")).alias(m) for m in metrics]
    )


def with_shares(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the share ``p`` of each value in its group (totals are joined, groups are not gathered)."""
    keys = [quoted(b) for b in by]
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return counts.join(checked_broadcast(totals), list(by)).withColumn("p", F.col("n") / F.col("_total")).drop("_total")


def guarded_shannon(counts: DataFrame, by: Sequence[str], eps: float = E.LOG_GUARD) -> DataFrame:
    """Shannon entropy with ``eps`` inside the logarithm."""
    return (
        with_shares(counts, by)
        .groupBy(*[quoted(b) for b in by])
        .agg(E.shannon_guarded(F.col("p"), eps).alias("shannon"))
    )


def smoothed_shannon(
    counts: DataFrame, by: Sequence[str], bins: int, smoothing: float = 1e-10, base: float = 2.0
) -> DataFrame:
    """Entropy of a smoothed histogram of ``bins`` bins per group."""
    keys = [quoted(b) for b in by]
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return (
        counts.join(checked_broadcast(totals), list(by))
        .groupBy(*keys)
        .agg(E.shannon_smoothed(F.col("n"), F.col("_total"), bins, smoothing, base).alias("entropy"))
    )


def entropy_profile(
    df: DataFrame,
    by: Sequence[str],
    features: Sequence[str],
    metrics: Sequence[str] = ("shannon", "renyi_2", "min_entropy"),
    as_type: str = "double",
) -> DataFrame:
    """Long table ``(by..., feature, entropy, value)`` for all groups in one aggregate."""
    counts = value_counts(df, by, features, as_type)
    wide = count_entropies(counts, [*by, "feature"], metrics)
    return wide.unpivot(
        [*[quoted(b) for b in by], "feature"], [quoted(m) for m in metrics], "entropy", "value"
    )


def haar_energies(df: DataFrame, by: Sequence[str], idx: str, value: str) -> DataFrame:
    """Energies of the three-level Haar decomposition per group: ``a3, d3, d2, d1``.

    Eight neighbours make one block, so all three levels come from a single grouping. A row without
    a partner at the end of the series is paired with itself, level by level. Positions must be
    dense per group.
    """
    half = 2.0**0.5
    block = df.select(*[quoted(b) for b in by], F.expr(f"`{idx}` div 8").alias("_blk"),
                      F.pmod(F.col(idx), F.lit(8)).alias("_pos"), quoted(value).cast("double").alias("_x"))
    wide = block.groupBy(*[quoted(b) for b in by], "_blk").agg(
        *[F.max(F.when(F.col("_pos") == i, F.col("_x"))).alias(f"_v{i}") for i in range(8)]
    )
    level = [F.col(f"_v{i}") for i in range(8)]
    details = {}
    for depth in (1, 2, 3):
        pairs = [(level[i], F.coalesce(level[i + 1], level[i])) for i in range(0, len(level), 2)]
        details[f"_d{depth}"] = sum(
            (F.coalesce(F.pow((a - b) / half, F.lit(2.0)), F.lit(0.0)) for a, b in pairs), F.lit(0.0)
        )
        wide = wide.withColumns({f"_l{depth}_{i}": (a + b) / half for i, (a, b) in enumerate(pairs)})
        wide = wide.withColumns({f"_d{depth}": details[f"_d{depth}"]})
        level = [F.col(f"_l{depth}_{i}") for i in range(len(pairs))]
    return wide.groupBy(*[quoted(b) for b in by]).agg(
        F.sum(F.pow(level[0], F.lit(2.0))).alias("a3"),
        F.sum("_d3").alias("d3"),
        F.sum("_d2").alias("d2"),
        F.sum("_d1").alias("d1"),
    )


def wavelet_entropy(df: DataFrame, by: Sequence[str], idx: str, value: str) -> DataFrame:
    """Entropy of the energy shares of the three-level Haar decomposition."""
    parts = ["a3", "d3", "d2", "d1"]
    energies = haar_energies(df, by, idx, value)
    total = sum((F.col(p) for p in parts), F.lit(0.0))
    terms = [
        F.when(F.col(p) > 0, -(F.col(p) / total) * F.log2(F.col(p) / total)).otherwise(F.lit(0.0))
        for p in parts
    ]
    value_col = F.greatest(F.lit(0.0), sum(terms, F.lit(0.0)))
    return energies.select(*[quoted(b) for b in by], value_col.alias("wavelet_entropy"))


def feature_metrics(
    df: DataFrame,
    features: Sequence[str],
    metrics: Sequence[str],
    idx: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Feature x metric matrix: one row per (by..., feature), one column per named metric."""
    E.check_metrics(metrics)
    keys = [*by, "feature"]
    on_counts = [m for m in metrics if m in E.COUNT_METRICS]
    on_values = [m for m in metrics if m in E.VALUE_METRICS]
    parts: list[DataFrame] = []
    if on_counts:
        parts.append(count_entropies(value_counts(df, by, features), keys, on_counts))
    if on_values:
        long = unpivot_features(df, by, features, "double")
        parts.append(
            long.groupBy(*[quoted(k) for k in keys]).agg(
                *[E.VALUE_METRICS[m](F.col("value")).alias(m) for m in on_values]
            )
        )
    if "wavelet_entropy" in metrics:
        if idx is None:
            raise ValueError("the wavelet entropy needs a dense row position")
        long = unpivot_features(df, [*by, idx], features, "double")
        parts.append(wavelet_entropy(long, keys, idx, "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys)
    return out.select(*[quoted(k) for k in keys], *[quoted(m) for m in metrics])


def attack_metrics(
    df: DataFrame, label: str, attack: str, features: Sequence[str], idx: str | None = None
) -> DataFrame:
    """The metric matrix that the registry prescribes for one attack family, over its rows.

    ``idx`` is the position inside the attack's rows, needed where the wavelet entropy is asked for.
    """
    metrics = E.METRICS_OF_ATTACK.get(attack)
    if metrics is None:
        raise ValueError(f"no metrics registered for attack: {attack}")
    return feature_metrics(df.filter(quoted(label) == attack), features, metrics, idx)


def ordering_check(profile: DataFrame, by: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Check Shannon >= Renyi-2 >= min-entropy per group of a long profile."""
    kinds = ["shannon", "renyi_2", "min_entropy"]
    wide = profile.groupBy(*[quoted(b) for b in by]).pivot("entropy", kinds).agg(F.first("value"))
    holds = (F.col("shannon") + tolerance >= F.col("renyi_2")) & (
        F.col("renyi_2") + tolerance >= F.col("min_entropy")
    )
    return wide.withColumn("ordered", holds)


def select_by_entropy(
    df: DataFrame, label: str, attack: str, features: Sequence[str], share: float = 0.1
) -> DataFrame:
    """The ``share`` of features with the lowest entropy among the rows of one label."""
    keep = -(-len(features) * int(round(share * 1000)) // 1000)
    rows = df.filter(quoted(label) == attack)
    scored = count_entropies(value_counts(rows, [], features), ["feature"], ["shannon"])
    return scored.orderBy("shannon", "feature").limit(max(1, keep))
