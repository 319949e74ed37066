import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowscope.llm import op8_simhash as S


def brute_bits(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(bits):
    """bits by id -> smallest id reachable, by comparing all distinct fingerprints in numpy."""
    values = np.array(sorted(set(bits.values())), np.uint64)
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ v) <= 2) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    at = {int(v): root(i) for i, v in enumerate(values)}
    least = {}
    for doc, b in bits.items():
        least[at[b]] = min(doc, least.get(at[b], doc))
    return {doc: least[at[b]] for doc, b in bits.items()}


def test_whole_table(spark, sf_dir):
    rows = {r.doc_id: r for r in entry.queries()["op8_simhash_golay"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    bits = {r.doc_id: brute_bits(r.text or "") for r in docs}
    assert {d: int(r.fingerprint, 16) for d, r in rows.items()} == bits
    assert {d: r.component_id for d, r in rows.items()} == brute_components(bits)


def test_common_codeword():
    rng = random.Random(1)
    words = np.array([rng.getrandbits(23) for _ in range(2000)])
    other = words ^ np.array([sum(1 << b for b in rng.sample(range(23), rng.randint(0, 2))) for _ in words])
    for a, b in zip(S.codewords_near(words), S.codewords_near(other), strict=True):
        assert set(a) & set(b) - {-1}


def test_busy_buckets(spark):
    """A dense ball of fingerprints, chains, and far ones: small buckets and busy ones agree with brute force."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(400):
        values.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    chain = rng.getrandbits(64)
    for i in range(0, 40, 2):
        chain ^= (1 << i) | (1 << (i + 1))
        values.add(chain)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)]
    edges = S.links(spark.createDataFrame(signed, "bits long")).collect()
    assert all(bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 2 for e in edges)
    labels = {r.node % 2**64: r.label % 2**64 for r in S.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({v: v for v in values})
    groups = {}
    for v in values:
        groups.setdefault(labels.get(v, v), set()).add(v)
    expected = {}
    for v in values:
        expected.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_defined_cases(spark, documents):
    long = "word " * 30_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Two words"), (5, "two  WORDS"), (6, long), (6, long), (None, "two words")]
    df = documents(rows).withColumn("bits", F.lit("clash"))
    out = S.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {(r.doc, r.component) for r in out} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, 4)}
    assert {r.bits for r in out if r.doc in (1, 2, 3)} == {0}
    assert S.near_duplicates(documents([])).count() == 0
