"""Cleaning: names, bad numbers, labels, constant columns, scaling weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.functions import columns as C
from flowscope.functions.columns import quoted
from flowscope.operators.index import checked_broadcast, single_row


def strip_names(df: DataFrame) -> DataFrame:
    """Remove blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def squeeze_names(df: DataFrame) -> DataFrame:
    """Remove every blank from column names."""
    return df.toDF(*[c.replace(" ", "") for c in df.columns])


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in numeric_columns(df)])


def drop_bad_rows(df: DataFrame) -> DataFrame:
    """Infinite and NaN become null; rows with any null go."""
    floats = {
        f.name: C.finite_or_null(quoted(f.name)).cast(f.dataType)
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return (df.withColumns(floats) if floats else df).na.drop()


def coerce_numeric(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every column not in ``keep`` becomes a double; unreadable values become 0."""
    return df.select(
        *[quoted(c) if c in keep else C.number_or_zero(quoted(c)).alias(c) for c in df.columns]
    )


def truncate_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null becomes 0 and the features are cut to integers."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns({f: C.integer_or_zero(quoted(f), f in text) for f in features})


def impute_mean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null becomes the mean of its column."""
    means = single_row(df.agg(*[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)]))
    filled = df.withColumn("_m", means)
    return filled.withColumns(
        {f: F.coalesce(quoted(f).cast("double"), F.col(f"_m.m{i}")) for i, f in enumerate(features)}
    ).drop("_m")


def label_codes(df: DataFrame, label: str, name: str = "label_code") -> DataFrame:
    """Integer code of the label, in alphabetical order from 0."""
    classes = df.select(quoted(label).alias("_l")).filter(F.col("_l").isNotNull()).distinct()
    codes = classes.select("_l", (F.row_number().over(Window.orderBy("_l")) - 1).alias(name))
    return df.join(checked_broadcast(codes), quoted(label) == F.col("_l"), "left").drop("_l")


def one_hot_labels(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    return df.withColumns(C.one_hot(quoted(label), classes))


def constant_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Columns without variance, from one pass over the table."""
    row = df.agg(*[F.var_samp(quoted(f)).alias(f"v{i}") for i, f in enumerate(features)]).first()
    return [f for i, f in enumerate(features) if not (row[i] is not None and row[i] > 0)]


def drop_constant_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.drop(*constant_columns(df, features))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def weight_features(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Multiply columns by their weight."""
    return df.withColumns({c: quoted(c) * F.lit(float(w)) for c, w in weights.items()})


def melt_shares(df: DataFrame, method: str, cluster: str, parts: Sequence[str]) -> DataFrame:
    """Wide counts to long rows with the share of the cluster and of the method's total, in percent."""
    long = df.unpivot([method, cluster], list(parts), "class", "n")
    in_cluster = Window.partitionBy(method, cluster)
    in_method = Window.partitionBy(method)
    return long.withColumns(
        {
            "cluster_pct": F.try_divide(F.col("n") * 100.0, F.sum("n").over(in_cluster)),
            "method_pct": F.try_divide(F.col("n") * 100.0, F.sum("n").over(in_method)),
        }
    )


def prepare_flows(df: DataFrame, label: str = "Label") -> DataFrame:
    """The usual order: names, bad rows, derived features, collapsed label."""
    cleaned = drop_bad_rows(strip_names(df))
    return cleaned.withColumns({**C.derived_features(), "Class": C.collapse_label(quoted(label))})
