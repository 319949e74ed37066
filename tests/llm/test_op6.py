import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowscope.llm import op6_quality as Q


def one(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return Q.statistics(raw, np.array([0, len(raw)]))[0]


def test_statistics_do_not_depend_on_neighbours():
    texts = ["One two two.\nOne line", "", "a", "!!", "ÉÉ é\n\n", " ", "x y x", "\n", "tail\n"]
    raw = [t.encode() for t in texts]
    together = Q.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    assert np.isfinite(together).all()
    for row, text in zip(together, texts, strict=True):
        assert np.allclose(row, one(text)), text
    named = dict(zip(Q.NAMES, one("ab AB ab 12!\nab"), strict=True))
    assert np.isclose(named["words"], np.log1p(5)) and np.isclose(named["fresh_words"], np.sqrt(3 / 5)) and np.isclose(named["top_word"], np.sqrt(3 / 5))
    assert np.isclose(named["digits"], np.sqrt(2 / 15)) and np.isclose(named["same_marks"], np.sqrt(1 / 5))


def test_scores_are_density_differences():
    rng = np.random.default_rng(3)
    data = {0: rng.normal(1, 2, (400, Q.SIZE)), 1: rng.normal(0, 1, (900, Q.SIZE))}
    model = Q.fitted({k: (float(len(x)), x.sum(axis=0), x.T @ x) for k, x in data.items()})
    x = rng.normal(0.5, 1, (5, Q.SIZE))
    pooled = sum(len(d) * np.cov(d.T, bias=True) for d in data.values()) / 1300
    density = {}
    for k, d in data.items():
        c = (1 - Q.DIAGONAL) * ((1 - Q.POOLED) * np.cov(d.T, bias=True) + Q.POOLED * pooled) + Q.DIAGONAL * np.diag(np.diag(pooled)) + 1e-9 * np.eye(Q.SIZE)
        gap = x - d.mean(axis=0)
        density[k] = -0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap) - 0.5 * np.linalg.slogdet(c)[1]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(density[1] - density[0] + np.log(900 / 400)) / Q.SIZE)))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = entry.queries()["op6_quality"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_defined_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, "words"), (3, "words"), (None, "no id"), (4, "long " * 50_000)]
    docs = documents(rows).withColumn("x", F.lit("clash")).withColumn("score", F.lit(3))
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    out = Q.scored(docs, model, keep=("doc_id",)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    for known, score in (([], 0.5), ([(3, 1)], 1.0)):
        model = Q.fit(docs, spark.createDataFrame(known, "doc_id long, quality int"))
        assert {r.score for r in Q.scored(docs, model).collect()} == {score}
    assert Q.scored(documents([]), model).count() == 0
