"""Packed blocks of rows give what plain rows give, in every kernel that scores populations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.operators import assign as A
from flowscope.operators import fit as K
from flowscope.operators import mixture as M
from flowscope.operators import quality as Q
from flowscope.operators import search as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(300, 3)) + c for c in ([0, 0, 0], [5, 0, 1], [0, 6, -2])])
    table = [(i, [float(v) for v in r], int(i % 3 == 0)) for i, r in enumerate(x)]
    return spark.createDataFrame(table, "id bigint, features array<double>, y int").repartition(3).cache(), x


def test_packed_rows_score_as_plain_ones(rows):
    df, x = rows
    packed = A.pack(df, "features", "y")
    assert packed.columns == A.PACKED and packed.count() < 10
    # An empty cluster, two equal centroids and more clusters than are marked.
    sets = [x[:12].reshape(4, 3, 3), np.array([[[0.0, 0, 0], [0, 0, 0], [99, 99, 99]]]), x[None, : A.FEW + 4]]
    for s in sets:
        a, b = Q.score_population(df, s, label="y"), Q.score_population(packed, s)
        for c in ("clusters", "n", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin", "score"):
            assert b[c].to_numpy() == pytest.approx(a[c].to_numpy(), rel=1e-9)
        assert np.array_equal(np.stack(a["sizes"]), np.stack(b["sizes"])) and np.array_equal(np.stack(a["attacks"]), np.stack(b["attacks"]))
        for p, one in enumerate(s):
            labels = A.squared_distances(x, one).argmin(axis=1)
            assert np.array_equal(b["sizes"][p], np.bincount(labels, minlength=len(one)))


def test_rows_equal_to_their_mean_are_no_distance_away(spark):
    df = spark.createDataFrame([([1e4 + 5.0 * (i % 2), 1e4],) for i in range(40)], "features array<double>")
    found = Q.score_population(A.pack(df), np.array([[[1e4, 1e4], [1e4 + 5, 1e4]]]))
    assert found["davies_bouldin"][0] == 0.0


def test_a_row_that_is_not_finite_counts_once(spark):
    df = spark.createDataFrame([([0.0],), ([1.0],), ([float("nan")],)], "features array<double>")
    sets = np.array([[[0.0], [1.0]]])
    assert Q.score_population(A.pack(df), sets)["sizes"][0].tolist() == Q.score_population(df, sets)["sizes"][0].tolist() == [2, 1]


def test_packed_mixtures(rows):
    df, x = rows
    start = np.stack([x[:2], x[300:302]])
    a = M.fit_mixtures(df, start, 4, label="y")
    b = M.fit_mixtures(A.pack(df, "features", "y"), start, 4, spreads=M.column_variances(df, 3))
    assert np.allclose(a.means, b.means) and np.allclose(a.variances, b.variances) and np.allclose(a.log_lik, b.log_lik)
    assert np.array_equal(a.sizes, b.sizes) and np.array_equal(a.attacks, b.attacks)


def test_searches_keep_blocks(rows, monkeypatch):
    df, _ = rows
    seen = []
    scored, summed = A.candidate_moments, M.em_sums
    monkeypatch.setattr(A, "candidate_moments", lambda d, *a, **b: seen.append(A.is_packed(d)) or scored(d, *a, **b))
    monkeypatch.setattr(M, "em_sums", lambda d, *a, **b: seen.append(A.is_packed(d)) or summed(d, *a, **b))
    S.swarm_centroids(df, 3, 4, 1)
    S.bee_colony(df, 3, ["id"], bees=2, iterations=1, limit=1)
    S.swarm_mixture_means(df, "y", 2, 3, 1, short=1, long=2)
    assert len(seen) > 6 and all(seen)


def test_a_row_without_a_label_is_no_attack(spark):
    df = spark.createDataFrame([([float(i)], None if i % 2 else 1) for i in range(40)], "features array<double>, y int").repartition(4)
    found = M.fit_mixtures(A.pack(df, "features", "y"), np.array([[[5.0], [30.0]]]), 2, spreads=M.column_variances(df, 1))
    assert found.attacks.sum() == 20 and found.sizes.sum() == 40


def test_full_mixture_goes_on_as_sparks(rows):
    df, _ = rows
    vectors = K.with_vector(df)
    of = lambda n: K.GaussianMixture(k=3, maxIter=n, seed=1, featuresCol="_vec").fit(vectors)
    parts = lambda m: (np.array(m.weights), *(np.array([g[c].toArray() for g in m.gaussiansDF.collect()]) for c in ("mean", "cov")))
    found = M.fit_full(A.pack(df), *parts(of(0)), 3)
    for a, b in zip(found, parts(of(3)), strict=True):
        assert np.allclose(a, b, rtol=1e-6)
