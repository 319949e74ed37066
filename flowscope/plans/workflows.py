"""The end-to-end analyses, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.functions import entropy as E
from flowscope.functions.columns import quoted
from flowscope.operators import clean as K
from flowscope.operators import entropy as N
from flowscope.operators import fit
from flowscope.operators import iforest as I
from flowscope.operators import reduce as D
from flowscope.operators import report as R
from flowscope.operators import reward as W
from flowscope.operators import sample as P
from flowscope.operators import stats as S
from flowscope.operators import supervised as M
from flowscope.operators import windows as V
from flowscope.session import cut_lineage


def window_entropies(
    df: DataFrame, idx: str, attack: str, features: Sequence[str] = C.FLOW_FEATURES, window: int = 100
) -> DataFrame:
    """Integer features, the row entropy prescribed for ``attack``, and its mean per window."""
    method = E.ENTROPY_OF_ATTACK.get(attack)
    if method is None:
        raise ValueError(f"no entropy registered for attack: {attack}")
    whole = K.truncate_features(df, features)
    return V.row_entropy_window_mean(whole, idx, features, method, window)


def entropy_label_split(
    df: DataFrame, idx: str, label: str, attack: str, features: Sequence[str] = C.FLOW_FEATURES, window: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Window entropy to best threshold to cluster purity: (rows with ``cluster``, purity table)."""
    rows = window_entropies(df, idx, attack, features, window)
    is_attack = quoted(label) == attack
    split = W.best_label_split(rows, "window_entropy", is_attack).first()
    clustered = rows.withColumn("cluster", (F.col("window_entropy") > split["threshold"]).cast("int"))
    return clustered, R.purity(clustered, "cluster", is_attack)


def select_low_entropy(df: DataFrame, label: str, attack: str, features: Sequence[str], share: float = 0.1) -> list[str]:
    """Names of the features with the lowest entropy given the attack."""
    return [r["feature"] for r in N.select_by_entropy(df, label, attack, features, share).collect()]


def explore_clusters(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    ids: Sequence[str],
    is_attack: Column,
    fraction: float = 0.3,
    bags: int = 4,
    top: int = 20,
    target: float = 0.8,
    ks: Sequence[int] = range(2, 6),
    max_iter: int = 300,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Bagged sample, outlier removal, importance, reduction, sweep over k, clusters and reports."""
    spark = df.sparkSession
    # Both are scanned many times below.
    bagged = cut_lineage(P.bagged_sample(df, label, fraction, bags, ids, seed))
    scaler = S.fit_standard_scaler(bagged, features)
    contamination = S.adaptive_contamination(bagged, features)
    scaled = scaler.transform(bagged).withColumn("features", C.features_array(features))
    flagged = I.flag_outliers(scaled, ids, contamination, seed=seed)
    kept = flagged.filter(~F.col("is_outlier"))
    first, _, _ = fit.kmeans(kept, max(ks), 1, max_iter, seed)
    ranking = M.cluster_importances(first, features, "cluster", top)
    best = [r["feature"] for r in ranking.collect()]
    reduction = D.fit_pca_to_variance(kept, best, target)
    reduced = reduction.transform(kept.drop("features")).withColumn("features", vector_to_array("components"))
    reduced = cut_lineage(reduced)
    models: dict[int, KMeansModel] = {}
    table = fit.sweep(reduced, ks, 1, max_iter, seed, fitted=models)
    # A fit of its own would give the same model again.
    clustered = fit.label_rows(models[int(table.loc[table["best"], "k"].iloc[0])], reduced)
    return {
        "outliers": I.removal_counts(flagged),
        "importance": ranking,
        "variance": reduction.variance_table(df),
        "sweep": spark.createDataFrame(table),
        "clusters": R.distribution(clustered, "cluster"),
        "purity": R.purity(clustered, "cluster", is_attack),
        "attack_share": R.share_within(clustered, label, "cluster"),
    }
