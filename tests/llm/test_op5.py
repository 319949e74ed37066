import random
import re

from pyspark.sql import functions as F

from flowscope.llm import op5_decontaminate as W

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                at = windows.get(tuple(w[s : s + n]))
                if at:
                    found |= at
                    hit.update(range(s, s + n))
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(spark, docs, items):
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("size", F.lit("clash"))
    return sorted(((r.doc, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in W.contamination(docs, frame).collect()), key=str)


def test_random_passages(spark, documents):
    rng = random.Random(6)
    bank = [f"w{i}" for i in range(12)] + ["É", "日本", "Don't", "x9"]
    text = lambda n: " ".join(rng.choice(bank) + rng.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 12, 13, 14, 20, 40]))) for i in range(12)] + [(50, None), (51, ""), (52, "...")]
    items += [(60, items[3][1]), (None, items[4][1])]
    docs = []
    for i in range(150):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items[:12])[1]).split(" ")
            s = rng.randint(0, max(0, len(w) - 13))
            parts += [" ".join(w[s : s + rng.choice([12, 13, 16, 40])]).upper(), text(rng.randint(0, 20))]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "a b c"), (200, docs[0][1]), (None, docs[1][1]), (203, f"{text(30_000)} {items[6][1]}")]
    known = [i for i in items if i[0] is not None]
    df = documents(docs).withColumn("row", F.lit("clash")).withColumn("item", F.lit(2))
    assert got(spark, df, known) == brute(docs, known)


def test_no_rows(spark, documents):
    assert got(spark, documents([]), [(1, "some words")]) == []
    assert got(spark, documents([(1, "some words")]), []) == [(1, 2, 0, [], False)]
