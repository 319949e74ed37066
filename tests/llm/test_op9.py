import collections
import random
import re
from math import log

import pytest
from pyspark.sql import functions as F

from flowscope.llm import op9_backoff as B

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(texts, order):
    docs = [WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    own = [collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in docs]
    total = sum(own, collections.Counter())
    n_all, out = sum(map(len, docs)), []
    for w, mine in zip(docs, own, strict=True):
        c = lambda g: total[g] - mine[g]  # noqa: E731, B023
        score, backed = 0.0, 0
        for i in range(len(w)):
            reach = min(order, i + 1)
            for n in range(reach, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    s = max(c(g), B.UNSEEN) / max(1, n_all - len(w))
                elif c(g) > 0 and c(g[:-1]) > 0:
                    s = c(g) / c(g[:-1])
                else:
                    continue
                score += log(s) + (reach - n) * log(B.ALPHA)
                backed += n < reach
                break
        out.append((len(w), backed, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, documents, order):
    rng = random.Random(order)
    bank = ["the", "The", "a", "cat", "dog", "É", "sat", "on", "mat", "日本", "x1"]
    texts = [" ".join(rng.choice(bank) + rng.choice(["", ".", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += [None, "", "...", "alone", "the " * 40_000, texts[3], texts[3]]
    ids = list(range(len(texts) - 3)) + [3, 3, None]
    df = documents(list(zip(ids, texts, strict=True))).withColumn("chunk", F.lit("clash")).withColumn("doc", F.lit(0))
    got = sorted((str(r.doc), r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in B.backoff_scores(df, order=order).collect())
    want = sorted((str(i), n, b, round(s, 6)) for i, (n, b, s) in zip(ids, brute(texts, order), strict=True))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-3)


def test_no_rows(spark, documents):
    assert B.backoff_scores(documents([])).count() == 0
    assert [(r.n_words, r.log_score, r.mean_log_score) for r in B.backoff_scores(documents([(1, None)])).collect()] == [(0, 0.0, 0.0)]
