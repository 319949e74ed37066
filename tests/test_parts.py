"""Kept tables and windows come in parts that do not grow with the table."""

import pytest
from pyspark.sql import functions as F

from flowscope import session as S
from flowscope.operators import supervised as M
from flowscope.operators import windows as W


@pytest.fixture(scope="module")
def grown_table(spark, tmp_path_factory):
    """Some 17 MB in one file, which the old bound of 128 MB left in as many parts as there are cores, or in one."""
    path = f"{tmp_path_factory.mktemp('parts')}/t"
    rows = spark.range(2_200_000).select(F.col("id"), F.xxhash64("id").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    rows.coalesce(1).write.option("compression", "none").parquet(path)
    return spark.read.parquet(path)


def test_kept_tables(grown_table):
    size = S.known_bytes(grown_table)
    assert size > 3 * S.BYTES_PER_PART
    assert S.spread(grown_table, 1).rdd.getNumPartitions() == -(-size // S.BYTES_PER_PART)
    assert S.spread(grown_table, 1).agg(F.count("*"), F.sum("id")).first()[:] == grown_table.agg(F.count("*"), F.sum("id")).first()[:]
    # A small table is left as it is.
    small = grown_table.sparkSession.range(10).coalesce(1)
    assert S.spread(small, 1).rdd.getNumPartitions() == 1


def test_fit_whole_spreads(grown_table, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "fit_classifier", lambda rows, *_: seen.append((rows.rdd.getNumPartitions(), rows.columns)))
    M.fit_whole(grown_table, ["x"], "y", None)
    assert seen == [(-(-S.known_bytes(grown_table) // S.BYTES_PER_PART), ["x", "y"])]


def test_checkpointed_tables(grown_table, monkeypatch):
    kept = S.cut_lineage(grown_table)
    written = S.known_bytes(kept)
    assert S.BYTES_PER_PART // 8 < written < 8 * S.known_bytes(grown_table)
    monkeypatch.setattr(S, "BYTES_PER_PART", 1 + written // 7)
    assert S.spread(kept, 1).rdd.getNumPartitions() == 7
    # What made a checkpoint says nothing of its size: the guess here is the product of two tables.
    joined = S.cut_lineage(grown_table.join(grown_table.select(F.col("id").alias("i")), F.col("id") == F.col("i")).where("id < 10"))
    assert S.spread(joined, 1).rdd.getNumPartitions() == 1
    seen = []
    monkeypatch.setattr(M, "fit_classifier", lambda rows, *_: seen.append(rows.rdd.getNumPartitions()))
    M.fit_whole(kept, ["x"], "y", None)
    assert 1 < seen[0] <= 7


def test_windows(grown_table):
    out = W.tumbling_entropy(grown_table, "id", ["x"], window=100, metrics=["shannon"], as_type="bigint")
    parts = -(-S.known_bytes(grown_table) // W.WINDOW_BYTES)
    assert parts > grown_table.sparkSession.sparkContext.defaultParallelism
    assert f"hashpartitioning(window_id#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and f", {parts}), REPARTITION_BY_NUM" in plan
    assert out.agg(F.count("*"), F.round(F.min("x_shannon"), 9)).first()[:] == (22_000, 6.64385619)
