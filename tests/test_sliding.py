import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowscope.streaming import runs as S
from flowscope.streaming.sliding import SlidingEntropy, sliding_entropies, stream_sliding_entropy


class Kept:
    """A state value without Spark."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), (None, "a", "b", "c")[e], int(x)) for i, (e, x) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, 5, n), strict=True))]


def test_entities_of_a_bucket_are_worked_on_in_one_call():
    """Three batches of four entities, one of them null and one that comes late: three calls, the values of each entity alone."""
    rows = [r for r in rows_of(120, 1) if r[1] != "c" or r[0] > 80]
    work = SlidingEntropy(["_bucket", "_entity", "i", "_bin"], 4, 5, ["i"], ["i"])
    work.init(Kept())
    got = {}
    for part in (rows[:40], rows[40:70], rows[70:]):
        frame = pd.DataFrame([(0, e, i, x) for i, e, x in reversed(part)], columns=["k", "e", "i", "x"])
        for out in work.handleInputRows((0,), iter([frame.iloc[:10], frame.iloc[10:]]), None):
            got.update({i: None if np.isnan(v) else round(v, 9) for i, v in zip(out["i"], out["entropy"], strict=True)})
    for entity in (None, "a", "b", "c"):
        own = [(i, x) for i, e, x in rows if e == entity]
        want = sliding_entropies(np.array([x for _, x in own]), 4, 5, 0)
        assert [got[i] for i, _ in own] == [None if np.isnan(v) else round(v, 9) for v in want]


def test_entities_keep_their_type_and_nulls(spark, tmp_path):
    big = (1 << 60) + 1
    rows = [(i, {None: None, "a": big, "b": big + 1, "c": -3}[e], x / 5) for i, e, x in rows_of(90, 2)]
    schema = "i long, e long, x double"
    for n in range(3):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = S.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "*.parquet")
    out, _ = S.drain(stream_sliding_entropy(stream, "e", "x", ["i"], ["i"], 4, 5, buckets=2), "buckets")
    assert out.schema["e"].dataType.simpleString() == "bigint"
    got = {r.i: r for r in out.withColumn("entropy", F.round("entropy", 9)).collect()}
    assert len(got) == 90
    for entity in (None, big, big + 1, -3):
        own = [(i, round(x * 5)) for i, e, x in rows if e == entity]
        want = sliding_entropies(np.array([x for _, x in own]), 4, 5, 0)
        assert [(got[i].e, got[i].entropy) for i, _ in own] == [(entity, None if np.isnan(v) else round(v, 9)) for v in want]
