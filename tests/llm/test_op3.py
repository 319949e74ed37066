import random

import numpy as np
from pyspark.sql import functions as F

from flowscope.llm import op3_lines as L
from tests.llm.test_pipeline import brute_lines


def kept(df):
    return [tuple(r) for r in L.with_lines_deduplicated(df, keep=("doc_id",)).select("doc_id", "kept", "n_lines", "n_dropped").collect()]


def test_random_lines(spark, documents):
    rng = random.Random(4)
    bank = [f"line number {i} é" for i in range(30)] + ["short", "  LINE number 3 É\t", "Line Number 3 é", "", " ", "ten chars!", "nine char", "日本日本日本日本日", "日本日本日本日本日本", "exactly once A", "xx\x0c\x0b"]
    rows = [(i, "\n".join(rng.choice(bank) for _ in range(rng.randint(0, 8)))) for i in rng.sample(range(10_000), 120)] + [(20_000, None)]
    df = documents(rows).withColumn("body", F.lit("clash")).withColumn("lost", F.lit(1))
    want = brute_lines(df.collect())
    got = kept(df)
    assert {d: k for d, k, _, _ in got} == want and len(got) == len(rows)
    for d, k, n, dropped in got:
        text = dict(rows)[d] or ""
        assert n == len(text.split("\n")) and dropped == n - (len(k.split("\n")) if k or dropped < n else 0)


def test_common_line_and_long_text(spark, documents):
    """A line that every document holds, within one task and across tasks."""
    common = "a line that all documents hold"
    rows = [(i, f"{common}\nown line number {i}") for i in range(500)] + [(900, "\n".join(f"long text line {i}" for i in range(40_000)) + f"\n{common}")]
    got = {d: (k, n) for d, k, _, n in kept(documents(rows).repartition(7))}
    assert got[0] == (rows[0][1], 0) and got[900] == (rows[-1][1].rsplit("\n", 1)[0], 1)
    assert all(got[i] == (f"own line number {i}", 1) for i in range(1, 500))


def test_repeated_rows_and_no_id(spark, documents):
    rows = [(3, "shared line one\nown words"), (3, "shared line one\nown words"), (None, "shared line one"), (7, "shared line two"), (None, "shared line two")]
    assert sorted(kept(documents(rows)), key=str) == sorted([(3, rows[0][1], 2, 0)] * 2 + [(None, "", 1, 1)] * 2 + [(7, "shared line two", 1, 0)], key=str)
    assert kept(documents([(1, "only one document"), (1, "only one document")])) == [(1, "only one document", 1, 0)] * 2
    assert kept(documents([])) == []


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 2**63, 50_000, np.uint64), rng.integers(0, 2**63, 50_000, np.uint64)
    at = rng.permutation(np.concatenate([np.arange(50_000), np.arange(500)]))
    found = L.twice_seen(high[at], low[at])
    repeated = np.isin(at, np.arange(500))
    assert found[repeated].all() and found[~repeated].mean() < 0.02
