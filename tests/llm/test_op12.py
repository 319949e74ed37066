import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowscope.llm import op12_variants as V


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words, ratio):
    out = {}
    for w, n in words.items():
        met = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(met, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form, n, len(met), words[form] if form else None]

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {(w, form, root(w), n, k, m) for w, (form, n, k, m) in out.items()}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("letters", "group"), [("ab", 4), ("ab", 4096), ("abcé", 16)])
def test_brute_force(spark, letters, group):
    """Words of few letters have many neighbours, runs of equal letters, and chains of forms; small groups are halved."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))): 3 ** rng.randrange(6) for _ in range(150)}
    words |= {"a" * i: i for i in range(5, 12)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({"size": F.lit(1), "best": F.lit(2)})
    assert rows_of(V.variants(df, 3, group)) == brute(words, 3)


def test_shared_half(spark):
    """Nearly all words share their first half: the window there is cut until the groups are small."""
    rng = random.Random(5)
    words = {"gemeinsam" + "".join(rng.choice("abcdefgh") for _ in range(rng.choice([8, 9]))): rng.randrange(1, 50) for _ in range(400)}
    words |= {w[:12] + rng.choice("abcdefgh") + w[13:]: 500 for w in list(words)[:200]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = V.partitions(df, 16).groupBy(*V.KEY).count().where("b - a > 1").agg(F.max("count")).first()[0]
    assert sizes <= 16
    assert rows_of(V.variants(df, 10, 16)) == brute(words, 10)


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in "abc" for b in "de" for c in "fgh")
    states, open_states = {}, [V.acceptor(words)]
    while open_states:
        s = open_states.pop()
        if id(s) not in states:
            states[id(s)] = s
            open_states += s.values()
    assert len(states) == 4


def test_counts_and_garbling(spark, documents):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    rows = [(i % 90, " ".join(rng.choice(vocabulary) for _ in range(80)).replace("a", "A", 3) + "É9ÿÿÿÿÿÿÿ") for i in range(100)] + [(None, " ".join(vocabulary)), (7, None), (8, "")]
    expected = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c.lower() <= "z" and ord(c) < 128 or "À" <= c <= "ÿ":
                run += c.lower() if ord(c) < 128 else c
                continue
            if run:
                h = zlib.crc32(f"{doc}:{run}".encode())
                if doc is not None and h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                expected[run] += 1
            run = ""
    expected = {w: n for w, n in expected.items() if len(w) >= 7 and n >= 2}
    df = documents(rows).withColumns({"word": F.lit("clash"), "n": F.lit(1)})
    assert {r.word: r.n for r in V.vocabulary(df, garbled=31).collect()} == expected


def test_defined_cases(spark, documents):
    long = "ab" * 100_000
    rows = [(1, long), (1, long), (2, "x" + long), (3, "x" + long), (4, None), (5, "seventy seventy seventeenth")]
    out = rows_of(V.variants(V.vocabulary(documents(rows))))
    assert out == {(long, None, long, 2, 1, None), ("x" + long, None, "x" + long, 2, 1, None), ("seventy", None, "seventy", 2, 0, None)}
    assert V.variants(V.vocabulary(documents([]))).count() == 0
