import hashlib
import struct

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowscope.llm import op1_imatch as I


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def terms(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def brute_signature(own, lexicon):
    out = []
    for i, (classes, used) in enumerate((*I.LEVELS, I.ALL_TERMS)):
        chosen = sorted(own if i == len(I.LEVELS) else own & lexicon)
        for c in range(used):
            part = [h for h in chosen if ((h % (1 << 64)) >> (3 + 12 * i)) % classes == c]
            seed = 42
            for h in part:
                seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=seed)
            out.append(seed & 0xFFFF if part else None)
    return out


def brute_likeness(a, b):
    shares, at = [], 0
    for _, used in (*I.LEVELS, I.ALL_TERMS):
        pairs = [(x, y) for x, y in zip(a[at : at + used], b[at : at + used], strict=True) if (x, y) != (None, None)]
        shares.append((len(pairs), sum(x == y for x, y in pairs) / len(pairs) if pairs else None))
        at += used
    good = [s for n, s in shares[:-1] if n >= I.FEW]
    if good:
        return max(good)
    return shares[-1][1] if shares[-1][0] >= I.FEW else next((s for _, s in shares if s is not None), 1.0)


def brute_lexicon(texts):
    """Each text counts once where copies are more than COPIED of the rows, which one copy more is in a small table."""
    assert len(texts) <= 1 / I.COPIED
    df = {}
    for t in set(texts):
        for h in terms(t):
            df[h] = df.get(h, 0) + 1
    n = len(set(texts))
    return {h for h, m in df.items() if max(2, I.LEAST * n) <= m <= I.MOST * n}


def brute(docs):
    """docs: (id, text) with distinct ids."""
    docs = sorted((i, t or "") for i, t in docs)
    lexicon = brute_lexicon([t for _, t in docs])
    shown = lambda s: "".join("----" if h is None else f"{h:04x}" for h in s)
    out = {}
    for k, (i, t) in enumerate(docs):
        other = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + other[:q]
        a, b, c = (brute_signature(terms(x), lexicon) for x in (t, edited, other))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), pytest.approx(brute_likeness(a, b)), pytest.approx(brute_likeness(a, c)))
    return out


def rows_of(df):
    return [(r[0], tuple(r[1:])) for r in df.collect()]


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = dict(rows_of(entry.queries()["op1_imatch"](spark, sf_dir)))
    assert got == brute(docs)
    near = sum(r[4] > r[5] for r in got.values()) / len(got)
    assert near > 0.95


def test_defined_cases(spark, documents):
    rows = [(1, None), (5, ""), (7, "Ünïcode 日本 text " * 3), (9, "one two three four five six"), (12, "long text words " * 20_000), (13, "one two three four five six")]
    df = documents(rows).withColumn("body", F.lit("clash")).withColumn("doc", F.lit(0))
    assert dict(rows_of(I.fingerprints_and_edits(df))) == brute(rows)
    repeated = rows_of(I.fingerprints_and_edits(documents([*rows, rows[3], (None, "no id here")])))
    assert len(repeated) == len(rows) + 2
    lone = dict(repeated)[None]
    assert lone[1] == hashlib.sha256(b"no id he").hexdigest() and lone[5] == 0
    assert len({r[2] for i, r in repeated if i in (9, 13)}) == 1


def test_one_and_no_rows(spark, documents):
    assert dict(rows_of(I.fingerprints_and_edits(documents([(3, "abcdefgh")]))))[3][1] == hashlib.sha256(b"abcdefab").hexdigest()
    assert rows_of(I.fingerprints_and_edits(documents([]))) == []


def test_copies_do_not_bend_the_lexicon(spark, sf_dir, documents):
    """A text that a third of all rows hold: its terms stay in the band, and its likeness to its edit does not fall."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    first = next(i for i, (_, t) in enumerate(docs) if t and 400 < len(t) < 2000)
    before = dict(rows_of(I.fingerprints_and_edits(documents(docs))))
    # Copies before the text, so that the next document stays the same.
    low = min(i for i, _ in docs) - 200
    after = dict(rows_of(I.fingerprints_and_edits(documents([*docs, *((low + i, docs[first][1]) for i in range(75))]))))
    assert after[docs[first][0]][4] >= before[docs[first][0]][4]
    assert sum(after[i][4] for i in before) >= sum(r[4] for r in before.values()) - 0.02 * len(before)
