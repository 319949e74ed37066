import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.operators import index as X
from flowscope.operators import windows as W
from flowscope.streaming.sliding import sliding_entropies


def test_row_index_with_copies_and_hot_key(spark, monkeypatch):
    monkeypatch.setattr(X, "COPIES_PER_TASK", 10)
    rows = [(1, "a")] * 57 + [(1, "b")] * 3 + [(k, "c") for k in range(2, 40)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    out = X.with_row_index(df, ["k", "v"]).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in out] == list(range(len(rows)))
    assert [(r["k"], r["v"]) for r in out] == sorted(rows)


def test_row_index_unique(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = X.with_row_index(df, ["k"], unique=True)
    assert out.filter("k <> row_idx").count() == 0


def test_file_row_index_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).write.parquet(path)
    out = X.with_file_row_index(spark, path)
    assert out.filter("id <> row_idx").count() == 0 and out.count() == 1000


def test_entity_index(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(5)]
    out = X.with_entity_index(spark.createDataFrame(rows, "e string, t int"), ["e"], ["t"])
    assert out.filter("t <> row_idx").count() == 0 and out.count() == 505


def test_running_sums(spark):
    x = np.random.default_rng(0).integers(0, 10_000, 3_000)
    values, counts = np.unique(x, return_counts=True)
    df = spark.createDataFrame([(float(v), int(c)) for v, c in zip(values, counts)], "x double, n int")
    up = X.running_sums(df, "x", {"c": F.col("n")}).orderBy("x").collect()
    assert [r["c"] for r in up] == np.cumsum(counts).tolist()
    down = X.running_sums(df, "x", {"c": F.col("n")}, descending=True).orderBy(F.desc("x")).collect()
    assert [r["c"] for r in down] == np.cumsum(counts[::-1]).tolist()


def brute_entropy(values):
    values = [v for v in values if v is not None]
    if not values:
        return 0.0
    _, c = np.unique(values, return_counts=True)
    p = c / c.sum()
    return max(0.0, float(-(p * np.log2(p)).sum()))


@pytest.mark.parametrize("window,chunk", [(1, 1), (2, 2), (5, 7), (16, 16), (30, 64), (200, 200)])
def test_sliding_entropy_matches_brute_force(spark, window, chunk):
    rng = np.random.default_rng(window)
    x = [None if rng.random() < 0.1 else int(v) for v in rng.integers(0, 5, 150)]
    df = spark.createDataFrame(list(enumerate(x)), "i bigint, x bigint")
    out = W.sliding_entropy(df, "i", "x", window, chunk=chunk).orderBy("i").collect()
    assert len(out) == len(x)
    for i, r in enumerate(out):
        if i < window - 1:
            assert r["entropy"] is None
        else:
            assert r["entropy"] == pytest.approx(brute_entropy(x[i - window + 1 : i + 1]), abs=1e-9)


def test_stream_kernel_equals_batch(spark):
    codes = np.random.default_rng(4).integers(0, 50, 900)
    whole = sliding_entropies(codes, 64, 50, 0)
    parts, kept = [], np.array([], dtype=np.int64)
    for piece in np.split(codes, [10, 100, 101, 500]):
        joined = np.concatenate([kept, piece])
        parts.append(sliding_entropies(joined, 64, 50, len(kept)))
        kept = joined[-63:]
    assert np.allclose(np.concatenate(parts), whole, equal_nan=True)
    df = spark.createDataFrame([(i, float(c) / 50 + 0.001) for i, c in enumerate(codes)], "i bigint, x double")
    batch = [r["entropy"] for r in W.sliding_histogram_entropy(df, "i", "x", 64).orderBy("i").collect()]
    assert np.allclose([np.nan if v is None else v for v in batch], whole, equal_nan=True, atol=1e-9)


def test_histogram_edge(spark):
    df = spark.createDataFrame([(0.0,), (0.999,), (1.0,)], "x double")
    assert [r[0] for r in df.select(W.histogram_bin(F.col("x"))).collect()] == [0, 49, 49]


def test_slope_and_sequences_across_chunks(spark):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).cast("double").alias("x"), F.lit("a").alias("y"))
    s = W.slope(df, "i", "x", chunk=8).orderBy("i").collect()
    assert s[0]["slope"] is None and all(s[i]["slope"] == 2 * i - 1 for i in range(1, 100))
    seq = W.sequences(df, "i", ["x"], "y", 7, chunk=10).orderBy("i").collect()
    assert len(seq) == 94
    assert all([v[0] for v in r["sequence"]] == [float(j * j) for j in range(r["i"] - 6, r["i"] + 1)] for r in seq)


def test_sequences_reject_bad_values(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, float("nan"), "a")], "i bigint, x double, y string")
    with pytest.raises(Exception, match="not finite"):
        W.sequences(df, "i", ["x"], "y", 2).collect()


def test_sigma_classes_keep_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "x double")
    classes = [r["Class_x"] for r in W.classify_by_sigma(df, ["x"]).orderBy("x").collect()]
    assert classes == [None, "Medium", "Medium", "Medium", "High"]
    share = W.class_shares(W.classify_by_sigma(df, ["x"]), ["x"]).first()
    assert (share["low_proportion"], share["high_proportion"]) == (0.0, 0.25)


def test_short_last_window(spark):
    df = spark.range(250).select("id", (F.col("id") % 4).alias("x"))
    out = {r["window_id"]: r for r in W.tumbling_entropy(df, "id", ["x"]).collect()}
    assert sorted(out) == [0, 1, 2] and out[2]["x_shannon"] == pytest.approx(2.0, abs=1e-2)
