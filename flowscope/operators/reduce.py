"""Principal components on centred features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators import stats as S

# Spark's PCA builds the D x D covariance on the driver and accepts at most this many columns.
MAX_COLUMNS = 65_535


@dataclass
class Reduction:
    """A fitted scaler and PCA; ``transform`` centres first, as Spark's model does not."""

    scaler: S.Scaler
    model: PCAModel
    explained: list[float]

    def transform(self, df: DataFrame, out: str = "components") -> DataFrame:
        return self.model.transform(_assembled(df, self.scaler)).drop("_v").withColumnRenamed("_pc", out)

    def loadings(self, df: DataFrame) -> DataFrame:
        """``(feature, component, loading)``."""
        pc = self.model.pc.toArray()
        rows = [
            (f, j + 1, float(pc[i, j])) for i, f in enumerate(self.scaler.columns) for j in range(pc.shape[1])
        ]
        return df.sparkSession.createDataFrame(rows, "feature string, component int, loading double")

    def variance_table(self, df: DataFrame) -> DataFrame:
        """``(component, ratio, cumulative)``."""
        rows, total = [], 0.0
        for i, ratio in enumerate(self.explained):
            total += ratio
            rows.append((i + 1, float(ratio), float(total)))
        return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


def _assembled(df: DataFrame, scaler: S.Scaler) -> DataFrame:
    scaled = {f"_f{i}": scaler.scaled(c) for i, c in enumerate(scaler.columns)}
    names = list(scaled)
    return VectorAssembler(inputCols=names, outputCol="_v").transform(df.withColumns(scaled)).drop(*names)


def fit_pca(df: DataFrame, features: Sequence[str], k: int, scaler: S.Scaler | None = None) -> Reduction:
    """PCA with ``k`` components on standardised (or given-scaled) features."""
    if len(features) > MAX_COLUMNS:
        raise ValueError("too many columns for a dense covariance")
    fitted = scaler or S.fit_standard_scaler(df, features)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(_assembled(df, fitted))
    return Reduction(fitted, model, [float(x) for x in model.explainedVariance.toArray()])


def components_for(explained: Sequence[float], target: float) -> int:
    """Smallest number of components whose cumulative share reaches ``target``."""
    total = 0.0
    for i, ratio in enumerate(explained):
        total += ratio
        if total >= target - 1e-12:
            return i + 1
    return len(explained)


def fit_pca_to_variance(
    df: DataFrame, features: Sequence[str], target: float = 0.8, scaler: S.Scaler | None = None
) -> Reduction:
    """PCA that keeps the smallest number of components explaining ``target`` of the variance.

    The full model tells the number, a second fit builds it.
    """
    full = fit_pca(df, features, len(features), scaler)
    return fit_pca(df, features, components_for(full.explained, target), full.scaler)


def preprocess(
    df: DataFrame, features: Sequence[str], row_id: str, scaling: str = "standard", target: float = 0.95
) -> tuple[DataFrame, Reduction]:
    """Outliers out, scale, reduce; keeps ``row_id`` so the surviving rows stay known."""
    kept = S.remove_outliers(df.select(row_id, *[F.col(f"`{f}`").cast("double").alias(f) for f in features]), features)
    scaler = S.fit_standard_scaler(kept, features) if scaling == "standard" else S.fit_robust_scaler(kept, features)
    reduction = fit_pca_to_variance(kept, features, target, scaler)
    return reduction.transform(kept).select(row_id, "components"), reduction
