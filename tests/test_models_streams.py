import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.operators import report as R
from flowscope.operators import supervised as M
from flowscope.operators import windows as W
from flowscope.operators.index import with_entity_index
from flowscope.plans.registry import query
from flowscope.sources import flows as G
from flowscope.sources import sinks as K
from flowscope.streaming import runs as S
from flowscope.streaming.sliding import batch_sliding_entropy, stream_sliding_entropy


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        a, b = rng.normal(), rng.normal()
        rows.append((i, float(a), float(b), "DDoS" if a + b > 0 else "Benign", "one" if i < 590 else "tiny"))
    return spark.createDataFrame(rows, "id bigint, a double, b double, Label string, c string").cache()


@pytest.mark.parametrize("make", [lambda: M.forest(10, 6), lambda: M.boosted(5, 3), lambda: M.network(2, 2, (8,), 60)])
def test_models_learn(labelled, make):
    model, scored = M.train_and_score(labelled, ["a", "b"], "Label", ["id"], make())
    hits = scored.filter("predicted = Label").count() / scored.count()
    assert hits > 0.85 and scored.count() == 151
    assert M.labels_of(model) == ["Benign", "DDoS"]


def test_model_round_trip(labelled, tmp_path):
    model = M.fit_classifier(labelled, ["a", "b"], "Label", M.forest(5, 4))
    M.save_model(model, str(tmp_path / "m"))
    again = M.predict(M.load_model(str(tmp_path / "m")), labelled)
    assert again.select("id", "predicted").exceptAll(M.predict(model, labelled).select("id", "predicted")).count() == 0
    top = M.importances(model, ["a", "b"], labelled, 1).collect()
    assert len(top) == 1 and 0 < top[0]["importance"] <= 1


def test_per_cluster_guard(spark, labelled):
    df = labelled.withColumn("Label", F.when(F.col("c") == "tiny", "Benign").otherwise(F.col("Label")))
    grown = []
    rows = {r["cluster"]: r for r in M.train_per_cluster(df, ["a", "b"], "Label", "c", ["id"], 5, 4, grown=grown).collect()}
    assert rows["tiny"]["status"] == "skipped: single class" and rows["tiny"]["accuracy_pct"] is None
    assert rows["one"]["status"] == "trained" and [m.name for m in grown[0].models] == ["one"]


def test_folds(labelled):
    folds = M.cross_validate(labelled, ["a", "b"], "Label", ["id"], 3, 3, 3)
    row = M.fold_summary(folds).first()
    assert row["folds"] == 3 and row["mean_accuracy"] > 70
    assert folds.agg(F.sum("n")).first()[0] == 600


def test_exports(spark, labelled, tmp_path):
    K.export_cluster_sides(labelled, "Label", "DDoS", str(tmp_path / "sides"))
    back = spark.read.parquet(str(tmp_path / "sides"))
    assert back.count() == 600 and back.filter("side = 'positive' AND Label <> 'DDoS'").count() == 0
    summary = K.run_summary("m", R.class_guard(labelled, "c", "Label"))
    K.write_summary(summary, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["model"] == "m"


def test_prepared_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert G.materialise_or_load(spark, str(tmp_path / "p"), build).count() == 5
    assert len(calls) == 1


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Events of three entities in several files, one of them hot."""
    path = str(tmp_path_factory.mktemp("feed") / "in")
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 else f"e{i % 2}", i, float(rng.random())) for i in range(1200)]
    df = spark.createDataFrame(rows, "e string, i bigint, x double")
    df.filter("i < 500").coalesce(1).write.parquet(path)
    df.filter("i BETWEEN 500 AND 900").coalesce(1).write.mode("append").parquet(path)
    df.filter("i > 900").coalesce(1).write.mode("append").parquet(path)
    return path, df


def test_stream_equals_batch(spark, feed):
    path, df = feed
    stream = S.read_stream(spark, path, df.schema, "*.parquet")
    out, cost = S.logged(spark, lambda: S.drain(stream_sliding_entropy(stream, "e", "x", ["i"], ["i"], 32), "t"))
    got = {(r["e"], r["i"]): r["entropy"] for r in out.collect()}
    batch = W.sliding_histogram_entropy(with_entity_index(df, ["e"], ["i"], unique=True), "row_idx", "x", 32, entity=["e"])
    want = {(r["e"], r["i"]): r["entropy"] for r in batch.collect()}
    assert got.keys() == want.keys() and len(got) == 1200
    for key, value in want.items():
        assert got[key] == (None if value is None else pytest.approx(value, abs=1e-9))
    hot, _ = batch_sliding_entropy(stream, "e", "x", ["i"], ["i"], 32)
    assert {(r["e"], r["i"]): r["entropy"] for r in hot.collect()} == pytest.approx(want, abs=1e-9, nan_ok=True)
    assert cost.agg(F.sum("rows")).first()[0] == 1200
    assert S.amortised_cost(cost, 10.0, 1024).first()["amortised_ms"] > 0


def test_deep_trees_are_refused():
    with pytest.raises(ValueError, match="at most 30"):
        M.forest(5, 50)


def test_long_streams_are_accounted_for(spark, tmp_path):
    """More batches than the engine's own list of recent progress holds."""
    path = str(tmp_path / "many")
    spark.range(105).coalesce(1).write.option("maxRecordsPerFile", 1).parquet(path)
    stream = S.read_stream(spark, path, spark.read.parquet(path).schema, "*.parquet")
    _, log = S.logged(spark, lambda: S.drain(stream, "many"))
    assert log.agg(F.sum("rows")).first()[0] == 105 and log.filter("rows > 0").count() == 105


def test_time_windows(spark):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "b"), ("2024-01-01 07:00:00", "a")]
    df = spark.createDataFrame(rows, "t string, v string").withColumn("t", F.col("t").cast("timestamp"))
    out = {r["n"]: r for r in S.time_window_entropy(df, "t", "v", "6 hours").collect()}
    assert out[2]["shannon"] == pytest.approx(1.0) and out[1]["shannon"] == 0.0


def test_query_names_are_unique():
    import __spark_entry__

    name = next(iter(__spark_entry__.queries()))
    with pytest.raises(ValueError):
        query(name)(lambda s, d: None)


def test_schema_helpers():
    schema = G.connection_schema()
    assert len(schema) == 25 and schema["Label"].dataType == T.StringType()
    wide = G.integers_as_double(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("s", T.StringType())]))
    assert [f.dataType.simpleString() for f in wide] == ["double", "string"]
