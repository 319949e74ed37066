import pytest
from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.operators import clean as K
from flowscope.operators import evaluate as V
from flowscope.operators import report as R
from flowscope.operators import sample as P
from flowscope.operators import stats as S
from flowscope.sources import flows as G


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], [" a b", "c "])
    assert K.strip_names(df).columns == ["a b", "c"] and K.squeeze_names(df).columns == ["ab", "c"]


def test_bad_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("inf"), "b"), (float("nan"), "c"), (None, "d"), (-float("inf"), "e"), (2.0, None)], "x double, y string")
    assert [r["x"] for r in K.drop_bad_rows(df).collect()] == [1.0]


def test_coerce_and_truncate(spark):
    df = spark.createDataFrame([("1.9",), ("-1.9",), ("x",), (None,)], "x string")
    assert [r[0] for r in K.coerce_numeric(df, []).collect()] == [1.9, -1.9, 0.0, 0.0]
    assert [r[0] for r in K.truncate_features(df, ["x"]).collect()] == [1, -1, 0, 0]
    num = spark.createDataFrame([(2.7,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in K.truncate_features(num, ["x"]).collect()] == [2, 0, 0, 0]


def test_arg_max_takes_the_first(spark):
    df = spark.createDataFrame([(1, 3, 3)], "a int, b int, c int")
    assert df.select(C.arg_max(["a", "b", "c"])).first()[0] == "b"


def test_melt_shares_of_the_published_table(spark):
    rows = [("PCA", "0", 9066, 15566), ("PCA", "1", 8, 15360)]
    out = K.melt_shares(spark.createDataFrame(rows, "m string, c string, Benign bigint, DDoS bigint"), "m", "c", ["Benign", "DDoS"])
    found = {(r["c"], r["class"]): r for r in out.collect()}
    assert found["1", "DDoS"]["cluster_pct"] == pytest.approx(99.948, abs=1e-3)
    assert sum(r["method_pct"] for r in found.values()) == pytest.approx(100)


def test_constant_columns_and_codes(spark):
    df = spark.createDataFrame([(1.0, 5.0, "b"), (2.0, 5.0, "a")], "x double, y double, l string")
    assert K.constant_columns(df, ["x", "y"]) == ["y"]
    assert {r["l"]: r["label_code"] for r in K.label_codes(df, "l").collect()} == {"a": 0, "b": 1}


def test_labelled_scan(spark, tmp_path):
    for name in ("Syn-training", "UDP-training"):
        spark.range(3).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "broken-training.parquet").write_bytes(b"not parquet")
    df = G.labelled_scan(spark, str(tmp_path), "*-training.parquet", spark.range(1).schema)
    assert {r["Label"]: r["count"] for r in df.groupBy("Label").count().collect()} == {"Syn": 3, "UDP": 3}
    with pytest.raises(FileNotFoundError):
        G.labelled_scan(spark, str(tmp_path), "nothing*.parquet")


def test_ragged_union(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "b"))
    df = G.load_flows(spark, str(tmp_path), {"one": "a", "two": "b"})
    assert df.count() == 4 and df.filter("x IS NULL").count() == 2


def test_exact_quotas_with_a_hot_label(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("y"))
    kept = P.stratified_sample(df, "y", 0.3, ["id"])
    before = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    after = {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()}
    assert after == {y: round(0.3 * n) for y, n in before.items()}
    again = P.stratified_sample(df.repartition(7), "y", 0.3, ["id"])
    assert kept.exceptAll(again).count() == 0


def test_split_parts_are_whole_and_disjoint(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4).cast("string").alias("y"))
    flagged = P.stratified_split(df, "y", 0.25, ["id"])
    assert flagged.count() == 1000 and flagged.filter("is_test").count() == 252
    assert flagged.select("id").distinct().count() == 1000


def test_sizes_and_seeds(spark):
    df = spark.range(700)
    assert P.working_sample(df, 123, ["id"]).count() == 123
    assert P.working_sample(df, 10_000, ["id"]).count() == 700
    seeds = P.draw_seeds(df, 5, ["id"], 9).collect()
    assert len(seeds) == 45 and len({(r["candidate"], r["id"]) for r in seeds}) == 45
    with pytest.raises(ValueError):
        P.stratified_size(df.withColumn("y", F.lit("one")), "y", 10, ["id"])
    bags = P.bagged_sample(spark.range(20_000).withColumn("y", F.lit("a")), "y", 0.3, 4, ["id"]).count()
    assert abs(bags / 20_000 - (1 - 0.7**4)) < 0.02


@pytest.mark.parametrize("hot", [False, True])
def test_exact_quantiles(spark, hot):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.lognormal(0, 4, 5000)
    if hot:
        x[:2000] = 1.25
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    found = S.exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.77, 1.0])["x"]
    assert found == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.77, 1.0]).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert S.exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def test_constant_column_passes_the_zscore_filter(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(50)] + [(1e6, 1.0)], "x double, c double")
    assert S.zscore_filter(df, ["x", "c"]).count() == 50


def test_ks_agrees_with_spark(spark):
    df = spark.range(500).select((F.col("id") % 37 + F.col("id") / 500.0).alias("x"))
    ours, theirs = S.ks_statistic(df, "x").first()["d"], S.normality_test(df, "x").first()["d"]
    assert ours == pytest.approx(theirs, abs=1e-6)


def test_empty_aggregates(spark):
    row = R.traffic_aggregates(spark.createDataFrame([], "x int")).first()
    assert (row["n_flows"], row["psh_share"], row["mean_length"]) == (0, 0.0, 0.0)


def test_auc_extremes_and_ties(spark):
    auc = lambda rows: V.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y")).first()["auc"]
    assert auc([(0.9, True), (0.8, True), (0.1, False)]) == 1.0
    assert auc([(0.1, True), (0.9, False)]) == 0.0
    assert auc([(0.5, True), (0.5, False)]) == 0.5


def test_undefined_scores_are_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "t string, p string")
    out = {r["class"]: r for r in V.class_scores(df, "t", "p", ["a", "b"]).collect()}
    assert out["b"]["precision"] == 0.0 and out["b"]["f1"] == 0.0 and out["a"]["recall"] == 1.0
    cells = V.confusion(df, "t", "p", ["a", "b"])
    assert cells.count() == 4 and cells.filter("n = 0").count() == 2


def test_quantiles_over_all_magnitudes_in_five_passes(spark):
    """From 1e-300 to 1e299, both signs and both zeros; the upstream table is read once, its rows five times."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([10.0 ** rng.uniform(-300, 299, 3000), -(10.0 ** rng.uniform(-300, 299, 3000)), [0.0, -0.0, 5e-324, float("inf"), float("nan")]])
    y = rng.integers(-3, 3, len(x)).astype(float)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").mapInArrow(counted, "x double, y double")
    spark.sparkContext.setJobGroup("quantiles", "")
    probs = [0.0, 0.003, 0.25, 0.5, 0.9999, 1.0]
    found = S.exact_quantiles(df, ["x", "y"], probs)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles"))
    spark.sparkContext.setJobGroup("other", "")
    finite = x[np.isfinite(x)]
    assert found["x"] == pytest.approx(np.quantile(finite, probs).tolist(), rel=1e-12)
    assert found["y"] == np.quantile(y, probs).tolist()
    # A job to fill the cache may come on top of at most two a pass.
    assert read.value == len(x) and jobs <= 2 * len(S.DIGITS) + 1


def test_ordered_keys():
    import numpy as np

    x = np.array([-np.finfo(float).max, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1e-300, 2.0, 1e299])
    keys = S.ordered_keys(x)
    assert (np.diff(keys.astype(object)) > 0).all() and [S.value_of_key(int(k)) for k in keys] == x.tolist()
    assert S.ordered_keys(np.array([-0.0])) == S.ordered_keys(np.array([0.0]))
