import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.streaming import batches as N
from flowscope.streaming import runs as S


def feed(spark, path, ids):
    spark.createDataFrame([(i, float(i % 7)) for i in ids], "id long, x double").coalesce(1).write.mode("append").parquet(path)
    return S.read_stream(spark, path, T.StructType().add("id", T.LongType()).add("x", T.DoubleType()), "*.parquet")


def sizes(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(size=len(frame), first=int(frame["id"].iloc[0]))


ADDED = T.StructType().add("size", T.LongType()).add("first", T.LongType())


def per_batch(out):
    return [(r.batch, r.n, r.low, r.high) for r in out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("batch").collect()]


def test_batches_whatever_the_triggers_bring(spark, tmp_path):
    path, start = str(tmp_path / "in"), 0
    for n in (3, 25, 1, 40, 2):
        stream = feed(spark, path, range(start, start + n))
        start += n
    out, _ = N.batches_by_count(stream, sizes, ADDED, ["id"], 10)
    assert per_batch(out) == [(i, 10, 10 * i, 10 * i + 9) for i in range(7)] + [(7, 1, 70, 70)]
    assert all(r.first == 10 * r.batch and r["size"] == (1 if r.batch == 7 else 10) for r in out.collect())
    open_end, _ = N.batches_by_count(stream, sizes, ADDED, ["id"], 10, flush=False)
    assert per_batch(open_end) == [(i, 10, 10 * i, 10 * i + 9) for i in range(7)]


def test_stopped_stream_goes_on(spark, tmp_path):
    path, folders = str(tmp_path / "in"), {"sink": str(tmp_path / "out"), "state": str(tmp_path / "state")}
    first, _ = N.batches_by_count(feed(spark, path, range(17)), sizes, ADDED, ["id"], 10, **folders)
    assert per_batch(first) == [(0, 10, 0, 9), (1, 7, 10, 16)]
    again, _ = N.batches_by_count(feed(spark, path, range(17, 34)), sizes, ADDED, ["id"], 10, **folders)
    assert per_batch(again) == [(0, 10, 0, 9), (1, 10, 10, 19), (2, 10, 20, 29), (3, 4, 30, 33)]
    rows = sorted(again.collect())
    same, _ = N.batches_by_count(S.read_stream(spark, path, spark.read.parquet(path).schema, "*.parquet"), sizes, ADDED, ["id"], 10, **folders)
    assert sorted(same.collect()) == rows


def test_no_rows(spark, tmp_path):
    out, _ = N.batches_by_count(feed(spark, str(tmp_path / "in"), []), sizes, ADDED, ["id"], 10)
    assert out.count() == 0


def test_clusters(spark, tmp_path):
    path = str(tmp_path / "in")
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(0 if i % 2 else 8)), float(rng.normal(0 if i % 2 else 8, 2))) for i in range(250)] + [(250, None, 1.0)]
    spark.createDataFrame(rows, "id long, x double, y double").coalesce(1).write.parquet(path)
    stream = S.read_stream(spark, path, spark.read.parquet(path).schema, "*.parquet")
    out, _ = N.cluster_stream(stream, ["x", "y"], ["id"], size=100)
    assert per_batch(out) == [(0, 100, 0, 99), (1, 100, 100, 199), (2, 51, 200, 250)]
    for batch in out.where("id < 250").select("batch", (F.col("id") % 2).alias("truth"), "cluster").toPandas().groupby("batch"):
        assert pd.crosstab(batch[1]["truth"], batch[1]["cluster"]).max(axis=1).sum() >= 0.97 * len(batch[1])
    assert out.where("id = 250").first().cluster is None


def test_mixture_of_equal_rows():
    assert len(N.mixture_labels(np.zeros((5, 2)), 2)) == 5
    with pytest.raises(ValueError):
        N.mixture_labels(np.zeros((0, 2)), 2)
