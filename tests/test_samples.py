"""Quotas on rows that repeat, and values that are not finite."""

import pytest
from pyspark.sql import functions as F

from flowscope.operators import evaluate as V
from flowscope.operators import fit as K
from flowscope.operators import reward as W
from flowscope.operators import sample as P
from flowscope.operators import stats as S


@pytest.fixture(scope="module")
def equal(spark):
    return spark.range(1000).select(F.lit("a").alias("label"), F.lit(1).alias("x"))


def test_quotas_within_copies(equal):
    assert P.stratified_sample(equal, "label", 0.3, ["x"]).count() == 300
    assert P.working_sample(equal, 100, ["x"]).count() == 100
    flagged = P.stratified_split(equal.limit(500), "label", 0.25, ["x"])
    assert {r["is_test"]: r["count"] for r in flagged.groupBy("is_test").count().collect()} == {True: 125, False: 375}


def test_copies_beside_other_rows(spark, equal, monkeypatch):
    monkeypatch.setattr(P, "COPIES", 7)
    df = equal.unionByName(spark.range(200).selectExpr("'b' AS label", "CAST(id AS INT) AS x")).unionByName(equal.limit(50).withColumn("x", F.lit(None).cast("int")))
    for seed in range(4):
        flagged = P.stratified_split(df, "label", 0.25, ["x"], seed=seed).cache()
        rows = {(r["label"], r["is_test"]): r["count"] for r in flagged.groupBy("label", "is_test").count().collect()}
        assert rows == {("a", True): 263, ("a", False): 787, ("b", True): 50, ("b", False): 150}
        assert flagged.drop("is_test").exceptAll(df).count() == 0
    bags = P.bagged_sample(df, "label", 0.3, 3, ["x"])
    assert bags.exceptAll(df).count() == 0 and bags.filter("label = 'a'").count() >= 315


def test_full_slot_is_cut_again(spark, monkeypatch):
    df = spark.range(5000).selectExpr("'a' AS label", "id")
    want = {r["id"] for r in P.stratified_sample(df, "label", 0.3, ["id"]).collect()}
    monkeypatch.setattr(P, "FULL_SLOT", 10)
    monkeypatch.setattr(P, "SLOTS", 16)
    quota = F.round(F.col("n") * 0.3)
    flagged = P.flag_by_rank(df, ["label"], P.hash_key(["id"]), ["id"], quota, slots=16)
    assert {r["id"] for r in flagged.filter("selected").collect()} == want and len(want) == 1500


def test_values_that_are_not_finite(spark):
    rows = [(float(i), i > 5) for i in range(10)] + [(float("nan"), True), (float("inf"), False), (None, True)]
    df = spark.createDataFrame(rows, "x double, y boolean")
    assert V.auc(df, "x", F.col("y")).first().asDict() == {"positives": 4, "negatives": 6, "auc": 1.0}
    assert S.ks_statistic(df, "x").first()["n"] == 10
    sides = {r["side"]: r["count"] for r in K.two_means_1d(df, "x").groupBy("side").count().collect()}
    assert sides == {"A": 5, "B": 5, None: 3}
    best = W.best_label_split(df, "x", F.col("y")).first()
    assert (best["threshold"], best["errors"], best["n"]) == (5.0, 0, 10)
    assert S.zscore_filter(df, ["x"]).count() == 10
