import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowscope.llm import op7_toxicity as T


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    rows = entry.queries()["op7_toxicity"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    share = lambda label: np.mean([r.predicted for r in held if labels[r.doc_id] == label])
    assert share(0) < 0.04 and share(1) > 0.8


def test_compression_distance():
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["vilezork", "grumblax", "sneerwip"]
    text = lambda p: " ".join(rng.choice(bad) if rng.random() < p else rng.choice(plain) for _ in range(200)).encode()
    model = T.fitted([text(0.05) for _ in range(200)], [text(0) for _ in range(400)])
    assert all(w.encode() in model.toxic for w in bad) and not any(w.encode() in model.ordinary for w in bad)
    assert all(model.score(text(0.05)) > 0.5 for _ in range(30)) and all(model.score(text(0)) < 0.5 for _ in range(30))
    toxic, ordinary = (len(c.compress(b" vilezork " + T.TAIL)) for c in model.compressors)
    assert toxic < ordinary


def test_defined_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, "words"), (3, "words"), (None, "no id"), (4, "long " * 50_000)]
    docs = documents(rows).withColumn("body", F.lit("clash")).withColumn("score", F.lit(3))
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    out = T.scored(docs, T.fit(docs, labels), keep=("doc_id",)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    for known, score in (([], 0.0), ([(3, 0)], 0.0), ([(3, 1)], 1.0)):
        model = T.fit(docs, spark.createDataFrame(known, "doc_id long, toxic int"))
        assert {r.score for r in T.scored(docs, model).collect()} == {score}
    assert T.scored(documents([]), model).count() == 0
