import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.functions import entropy as E
from flowscope.operators import entropy as O


def entropies(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    metrics = list(E.COUNT_METRICS)
    return O.count_entropies(O.value_counts(df, [], ["x"]), ["feature"], metrics).first().asDict()


def test_uniform_values_reach_the_maximum(spark):
    h = entropies(spark, list(range(16)) * 3)
    assert h["shannon"] == pytest.approx(4) and h["renyi_2"] == pytest.approx(4) and h["min_entropy"] == pytest.approx(4)


def test_constant_is_zero(spark):
    h = entropies(spark, [7] * 20)
    assert all(h[m] == 0.0 for m in E.COUNT_METRICS)


def test_ordering_of_orders(spark):
    rng = random.Random(5)
    rows = [(g, float(int(rng.expovariate(0.3)))) for g in range(8) for _ in range(200)]
    df = spark.createDataFrame(rows, "g int, x double")
    profile = O.entropy_profile(df, ["g"], ["x"])
    checked = O.ordering_check(profile, ["g", "feature"])
    assert checked.count() == 8 and checked.filter("NOT ordered").count() == 0


def test_renyi_tends_to_shannon(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 2)], "g int, n int")
    row = df.groupBy("g").agg(E.shannon(F.col("n")).alias("s"), E.renyi(F.col("n"), 1.0001).alias("r")).first()
    assert row["s"] == pytest.approx(row["r"], abs=1e-3)


def haar(x):
    parts = []
    for _ in range(3):
        if len(x) % 2:
            x = np.append(x, x[-1])
        parts.append(((x[0::2] - x[1::2]) / math.sqrt(2)) ** 2)
        x = (x[0::2] + x[1::2]) / math.sqrt(2)
    return [float((x**2).sum()), *[float(p.sum()) for p in reversed(parts)]]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 13, 24, 37])
def test_haar_energies_match_brute_force(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i bigint, x double")
    row = O.haar_energies(df, [], "i", "x").first()
    assert [row[c] for c in ("a3", "d3", "d2", "d1")] == pytest.approx(haar(x))


def test_haar_keeps_energy(spark):
    x = np.random.default_rng(1).normal(size=64)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i bigint, x double")
    assert sum(O.haar_energies(df, [], "i", "x").first()) == pytest.approx(float((x**2).sum()))


def test_fourier_energy_is_parseval(spark):
    x = np.random.default_rng(2).normal(size=50)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    found = df.agg(E.fourier_energy(F.col("x")).alias("e")).first()["e"]
    assert found == pytest.approx(float((np.abs(np.fft.fft(x)) ** 2).sum()))


def test_unknown_metric_is_an_error(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        O.feature_metrics(df, ["x"], ["nonsense"])
    with pytest.raises(ValueError):
        O.attack_metrics(df, "x", "unheard", ["x"])


def test_matrix_with_every_metric(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 9)), float(rng.integers(0, 3))) for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, a double, b double")
    metrics = [*E.COUNT_METRICS, *E.VALUE_METRICS, "wavelet_entropy"]
    out = {r["feature"]: r for r in O.feature_metrics(df, ["a", "b"], metrics, "i").collect()}
    for k, name in ((1, "a"), (2, "b")):
        energy = np.array(haar(np.array([r[k] for r in rows])))
        p = energy / energy.sum()
        assert out[name]["wavelet_entropy"] == pytest.approx(float(-(p * np.log2(p)).sum()))


def test_traffic_phases(spark):
    """A flood concentrates destinations, a scan spreads them."""
    n = 4_000
    normal = spark.range(n).select(F.lit("normal").alias("phase"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("dst"))
    flood = spark.range(n).select(F.lit("flood").alias("phase"), F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id") % 64).alias("dst"))
    scan = spark.range(n).select(F.lit("scan").alias("phase"), F.col("id").alias("dst"))
    df = normal.unionByName(flood).unionByName(scan)
    rows = O.entropy_profile(df, ["phase"], ["dst"]).collect()
    h = {(r["phase"], r["entropy"]): r["value"] for r in rows}
    for e in ("shannon", "renyi_2", "min_entropy"):
        assert h["flood", e] < h["normal", e] < h["scan", e]
