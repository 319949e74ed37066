import pytest

import __spark_entry__ as entry
from tests.llm.test_op9 import brute


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in entry.queries()["op9_backoff_order3"](spark, sf_dir).collect()}
    want = {d.doc_id: w for d, w in zip(docs, brute([d.text for d in docs], 3), strict=True)}
    assert {i: (r.n_words, r.n_backed_off) for i, r in got.items()} == {i: w[:2] for i, w in want.items()}
    assert [got[i].log_score for i in want] == pytest.approx([w[2] for w in want.values()], abs=1e-3)
