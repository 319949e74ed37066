import hashlib
from itertools import pairwise
from math import exp, expm1, log

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowscope.llm import op10_sentencepiece as S

PATH = public_tokenizers.path(S.VOCABULARY)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def pieces(model):
    return S.Pieces(model)


def brute(pieces, text):
    """All segmentations of a text with their probabilities, by plain recursion over the vocabulary."""
    of = {t.decode(errors="replace").replace(" ", S.MARK): i for i, t in enumerate(pieces.text) if t and i not in pieces.byte_id.values()}
    chars = S.MARK + text.replace(" ", S.MARK)

    def ways(at):
        if at == len(chars):
            yield (), 0.0
            return
        for to in range(at + 1, min(len(chars), at + 16) + 1):
            i = of.get(chars[at:to])
            if i is not None:
                head, weight = (i,), pieces.weight[i]
            elif to == at + 1:
                head = tuple(pieces.bytes_of(ord(chars[at])))
                weight = pieces.weight.min() * len(head)
            else:
                continue
            for rest, w in ways(to):
                yield head + rest, weight + w

    found = dict(ways(0)) if text else {(): 0.0}
    total = sum(map(exp, found.values()))
    return {ids: exp(w) / total for ids, w in found.items()}


def sampled(model, rows, k=3, seed=7):
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["c0", "doc", "body"])
    return [r for b in S.sampled(iter([batch]), model, k, seed, False) for r in b.to_pylist()]


@pytest.mark.parametrize("text", ["the", "on the", "é\nx", "日本 a", "Hi  you", "", "q", "ab😀"])
@pytest.mark.parametrize("block", [S.BLOCK, 2])
def test_against_all_segmentations(model, pieces, monkeypatch, text, block):
    monkeypatch.setattr(S, "BLOCK", block)
    want = brute(pieces, text)
    rows = sampled(model, [(5, text)], k=400)
    got = {tuple(r["ids"]): r for r in rows}
    assert len(got) == len(rows) == min(400, len(want)) and set(got) <= set(want)
    for ids, r in got.items():
        assert exp(r["log_prob"]) == pytest.approx(want[ids], rel=1e-6)
        assert r["decodes"] and pieces.decoded(list(ids)) == text
    assert all(a["perturbed"] > b["perturbed"] for a, b in pairwise(rows))
    if len(want) <= 400:
        assert all(r["inclusion"] == 1.0 for r in rows)


@pytest.mark.parametrize("block", [S.BLOCK, 1])
def test_frequencies(model, pieces, monkeypatch, block):
    """Over many keys, the two samples follow drawing without replacement, whether or not regions are pooled."""
    monkeypatch.setattr(S, "BLOCK", block)
    text, n = "on the", 12_000
    p = brute(pieces, text)
    rows = sampled(model, [(i, text) for i in range(n)], k=2)
    first, both = {}, {}
    for r in rows:
        ids = tuple(r["ids"])
        both[ids] = both.get(ids, 0) + 1
        if r["rank"] == 1:
            first[ids] = first.get(ids, 0) + 1
    for ids, q in p.items():
        assert abs(first.get(ids, 0) / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 2e-3
        second = q + sum(o * q / (1 - o) for other, o in p.items() if other != ids)
        assert abs(both.get(ids, 0) / n - second) < 5 * (second * (1 - second) / n) ** 0.5 + 2e-3
    # Dividing by the inclusion score makes sums over a sample unbiased: the weights of all segmentations add up to one.
    assert sum(exp(r["log_prob"]) / r["inclusion"] for r in rows) / n == pytest.approx(1, abs=0.03)


def test_inclusion_score(model):
    three, two = sampled(model, [(9, "some longer words here")], k=3), sampled(model, [(9, "some longer words here")], k=2)
    assert [r["ids"] for r in two] == [r["ids"] for r in three[:2]]
    for r in two:
        assert r["inclusion"] == pytest.approx(-expm1(-exp(r["log_prob"] - three[2]["perturbed"])), rel=1e-6)


def test_whole_table(spark, sf_dir):
    rows = entry.queries()["op10_sentencepiece"](spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) == n and all(r.decodes and r.n_pieces > 0 and 0 <= r.inclusion <= 1 for r in rows)
    for group in by.values():
        group.sort(key=lambda r: r["rank"])
        assert len({r.ids_sha256 for r in group}) == len(group) and [r["rank"] for r in group] == list(range(1, len(group) + 1))
        assert all(a.perturbed > b.perturbed for a, b in pairwise(group))
    assert log(len(rows)) > log(2 * n)


def test_query_gives_ids_and_decoded_texts(spark, documents, tmp_path):
    """The segmentations themselves, not only their digests, and what they decode to."""
    rows = [(1, "the same, twice"), (1, "the same, twice"), (2, ""), (3, None), (4, "日本 some a\x00é\n"), (None, "no id 😀")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["op10_sentencepiece"](spark, str(tmp_path)).collect()
    with open(PATH, "rb") as f:
        pieces = S.Pieces(f.read())
    assert len(out) == 4 * 3 + 2
    for r in out:
        assert r.decodes and r.decoded == (dict(rows)[r.doc_id] or "") == pieces.decoded(list(r.ids))
        assert r.n_pieces == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()


def test_defined_cases(spark, documents):
    long = "words in a long text, " * 9_000
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x"), (4, long), (5, "nospace" * 3_000), (6, "\x00 tab\t▁ mark")]
    df = documents(rows).withColumn("ids", F.lit("clash")).withColumn("body", F.lit(1))
    out = S.segmentations(df, PATH, keep=("doc_id", "lang")).collect()
    assert [(r["rank"], list(r.ids), r.inclusion) for r in out if r.doc_id in (1, 2)] == [(1, [], 1.0)] * 2
    assert len({(r["rank"], tuple(r.ids)) for r in out if r.doc_id == 3}) == 3 and len([r for r in out if r.doc_id == 3]) == 6
    assert len([r for r in out if r.doc_id == 4]) == 3 and all(r.decodes for r in out if r.doc_id != 6)
    ids = spark.createDataFrame([(1, [int(i) for i in next(r.ids for r in out if r.doc_id == 4)]), (2, None)], "k int, ids array<int>")
    assert [r.text for r in S.decoded(ids, PATH).orderBy("k").collect()] == [long, None]
    assert S.segmentations(documents([]), PATH).count() == 0


def test_memory_is_bound_by_characters_not_words(model, monkeypatch):
    rows, seen = [(i, f"{chr(97 + i % 26)}lphabet" * 2_500) for i in range(60)], []
    plain = S.slice_rows

    def slice_rows(batch, first, bodies, docs, places, counts, lattices, *rest):
        seen.append((sum(map(len, bodies)), len(lattices.label)))
        return plain(batch, first, bodies, docs, places, counts, lattices, *rest)

    monkeypatch.setattr(S, "SLICE", 50_000)
    monkeypatch.setattr(S, "KNOWN", 200_000)
    S.READY.clear()
    monkeypatch.setattr(S, "slice_rows", slice_rows)
    found = sampled(model, rows)
    most = max(n for n, _ in seen)
    assert most < 50_000 + 20_001
    # At most 16 edges leave a character.
    assert max(n for _, n in seen) <= 200_000 + 16 * (most + 3)
    assert len({r["c0"] for r in found}) == len(rows) and all(r["decodes"] for r in found)
    S.READY.clear()
    monkeypatch.undo()
    assert [r["ids"] for r in sampled(model, rows)] == [r["ids"] for r in found]
