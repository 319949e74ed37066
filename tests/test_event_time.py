import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.operators import windows as W
from flowscope.operators.index import with_entity_index
from flowscope.streaming import runs as S
from flowscope.streaming.event_time import event_time_entropy

START = dt.datetime(2024, 1, 1)
SCHEMA = "e string, t timestamp, i long, x double"


def table(spark, n=600):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"e{i % 4}", START + dt.timedelta(minutes=i // 2), i, float(rng.random())) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def write(df, path, low, high):
    """Rows whose jittered place lies within: neighbours up to 40 places apart come in any order, over files too."""
    place = F.col("i") + F.pmod(F.xxhash64("i"), F.lit(40))
    df.where((place >= low) & (place < high)).orderBy(F.xxhash64("i")).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, **folders):
    stream = S.read_stream(spark, path, spark.read.parquet(path).schema, "*.parquet")
    return S.drain(event_time_entropy(stream, "e", "x", "t", ["i"], ["i"], "30 minutes", 60_000 * 60, 16), "ordered", **folders)[0]


def expected(df, until):
    rows = W.sliding_histogram_entropy(with_entity_index(df, ["e"], ["t", "i"], unique=True), "row_idx", "x", 16, entity=["e"])
    return {(r.e, r.i): r.entropy for r in rows.where(F.col("t") <= F.lit(until)).collect()}


def same(out, want):
    rows = out.collect()
    got = {(r.e, r.i): r.entropy for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    for key, value in want.items():
        assert (got[key] is None or np.isnan(got[key])) if value is None else got[key] == pytest.approx(value, abs=1e-9)


def test_shuffled_rows_come_out_in_order_and_a_stopped_stream_goes_on(spark, tmp_path):
    df = table(spark).cache()
    path, folders = str(tmp_path / "in"), {"sink": str(tmp_path / "out"), "state": str(tmp_path / "state")}
    write(df, path, 0, 200)
    write(df, path, 200, 330)
    first = run(spark, path, **folders)
    assert 0 < first.count() < 330
    write(df, path, 330, 480)
    write(df, path, 480, 10_000)
    out = run(spark, path, **folders)
    latest = START + dt.timedelta(minutes=599 // 2)
    same(out, expected(df, latest - dt.timedelta(minutes=30)))


def test_idle_entities_leave_no_state(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    early = [("gone", START + dt.timedelta(minutes=i), i, 0.5) for i in range(20)]
    late = [("here", START + dt.timedelta(hours=9, minutes=i), 100 + i, 0.5) for i in range(20)]
    for rows in (early, late):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    out = run(spark, path, sink=str(tmp_path / "out"), state=state)
    assert out.where("e = 'gone'").count() == 20
    for name in ("recent", "last"):
        left = spark.read.format("statestore").option("stateVarName", name).load(state)
        assert "gone" not in {r.key[0] for r in left.select("key").collect()}


def test_a_call_serves_a_bucket_of_entities(spark, tmp_path):
    """Numbers as entities, a null one and rows without a time; the state has one row per bucket, not per entity."""
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    rng = np.random.default_rng(5)
    rows = [
        (None if i % 50 == 0 else i % 50, None if i % 97 == 0 else START + dt.timedelta(minutes=i // 4), i, f"n{i}", float(rng.random()))
        for i in range(2_000)
    ]
    df = spark.createDataFrame(rows, "e long, t timestamp, i long, name string, x double").cache()
    write(df, path, 0, 900)
    write(df, path, 900, 10_000)
    stream = S.read_stream(spark, path, df.schema, "*.parquet")
    found = event_time_entropy(stream, "e", "x", "t", ["i"], ["i", "name"], "30 minutes", 60_000 * 600, 16, buckets=3)
    assert found.dtypes == [("e", "bigint"), ("i", "bigint"), ("name", "string"), ("entropy", "double")]
    out, _ = S.drain(found, "ordered", sink=str(tmp_path / "out"), state=state)
    assert out.where("e is null").count() > 0
    timed = df.where("t is not null").fillna(-1, ["e"])
    same(out.fillna(-1, ["e"]), expected(timed, START + dt.timedelta(minutes=1_999 // 4 - 30)))
    assert out.where("name = concat('n', i)").count() == out.count()
    for name in ("recent", "last"):
        left = spark.read.format("statestore").option("stateVarName", name).load(state)
        assert 0 < left.count() <= 3


def test_idle_entities_leave_a_bucket(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    early = [(f"gone{i % 2}", START + dt.timedelta(minutes=i), i, 0.5) for i in range(20)]
    late = [("here", START + dt.timedelta(hours=9, minutes=i), 100 + i, 0.5) for i in range(20)]
    for rows in (early, late):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = S.read_stream(spark, path, spark.read.parquet(path).schema, "*.parquet")
    found = event_time_entropy(stream, "e", "x", "t", ["i"], ["i"], "5 minutes", 60_000 * 60, 16, buckets=1)
    out, _ = S.drain(found, "ordered", state=state)
    assert out.where("e like 'gone%'").count() == 20 and out.where("e = 'here'").count() == 15
    held = spark.read.format("statestore").option("stateVarName", "recent").load(state).select("value.entities").first()
    assert held.entities == ["here"]
