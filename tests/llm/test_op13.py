import math
import random

import pytest
from pyspark.sql import functions as F

from flowscope.llm import op13_topk as S


def scaled(v, scale=256):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(x)) for x in v]


def brute(rows, k=5, every=50):
    vectors = [(i, scaled(v)) for i, v in rows]
    out = []
    for a, (q, x) in enumerate(vectors):
        if x is None or q is None or q % every:
            continue
        scores = [(-sum(p * r for p, r in zip(x, y, strict=False)), i is None, i) for b, (i, y) in enumerate(vectors) if y is not None and b != a]
        out += [(q, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda e: (e[0], e[1], e[2] or 0))[:k])]
    return sorted(out, key=str)


def found(spark, rows, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"q": F.lit("clash"), "c": F.lit(1), "x": F.lit(2), "label": F.lit(0)})
    return sorted(((r.query, r.rank, r.id, r.score) for r in S.top_k(df, **settings).collect()), key=str)


@pytest.mark.parametrize(("gathered", "stripe"), [(1, 40), (64, 1 << 16)])
def test_brute_force(spark, monkeypatch, gathered, stripe):
    """Few distinct values give many ties; the first setting leaves much to the later phases and has many nodes."""
    monkeypatch.setattr(S, "STRIPE", stripe)
    monkeypatch.setattr(S, "BLOCK", 1 << 10)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, -0.01, 0.0, 0.25, 0.5]) for _ in range(9)]) for i in range(500)]
    assert found(spark, rows, gathered=gathered) == brute(rows)


def test_hot_vector_and_repeated_rows(spark):
    rng = random.Random(2)
    same = [0.5, 0.25, -0.25]
    rows = [(i, same) for i in range(300)] + [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(300, 600)]
    rows += [(100, same), (350, same), (350, [0.1, 0.1, 0.1]), (None, same), (0, same)]
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(0, None), (50, [1.0, None]), (100, [float("nan"), 1.0]), (150, [float("inf"), 1.0]), (200, [1.0, 2.0]), (201, [1.0]), (202, []), (250, []), (None, [3.0])]
    assert found(spark, rows) == brute([(i, None if v is None else [*v, 0.0, 0.0][:2] if all(x is not None for x in v) else v) for i, v in rows])
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, None)]) == []


def test_fewer_entries_than_all_reach_the_cutoff(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    objects, _ = S.objects(df, "vec_id", "embedding", 256, 50, 6)
    nodes = S.Nodes(objects)
    asking = objects.where("asks").select("c", "x", F.lit(200_000).cast("long").alias("floor"))
    above = nodes.run(objects, nodes.asks(asking), S.entries_above(nodes.lists))
    x = {r.c: r.x for r in objects.collect()}
    halves = {(q.c, c, part): sum(a * b for a, b in zip(q.x[8 * part : 8 * part + 8], v[8 * part : 8 * part + 8], strict=True)) for q in asking.collect() for c, v in x.items() for part in (0, 1)}
    assert {(r.q, r.c, r.list): r.score for r in above.collect()} == {key: s for key, s in halves.items() if 2 * s >= 200_000}
