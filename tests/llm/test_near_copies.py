import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from flowscope.llm import near_copies as N


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def like(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_labels(texts):
    """Index of the first text that near copies reach, by comparing all pairs."""
    sets, label = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and like(a, sets[j]):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return label


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def texts_with_near_copies(rng):
    texts = [None, "", "two words", "Two  WORDS"]
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(words), " ".join(edited(rng, words, len(words) // 60)), " ".join(edited(rng, words, len(words) // 10))]
    crowd = [f"c{rng.randrange(3000)}" for _ in range(400)]
    return texts + [" ".join(edited(rng, crowd, 3)) for _ in range(80)]


def test_components_against_brute_force(spark, documents):
    texts = texts_with_near_copies(random.Random(3))
    rows = documents(list(enumerate(texts))).withColumnRenamed("doc_id", "row")
    got = {r.row: r.label for r in N.components(rows).collect()}
    want, names = brute_labels(texts), {}
    assert all(names.setdefault(got[i], want[i]) == want[i] for i in range(len(texts)))
    assert len(names) == len(set(want))


def test_stage_removes_near_copies(spark, documents, tmp_path):
    """Copies with one word in sixty changed are no SimHash neighbours but go all the same."""
    texts = texts_with_near_copies(random.Random(4))
    documents(list(enumerate(texts))).write.parquet(f"{tmp_path}/docs")
    kept = {r.doc_id for r in P.near_dedup(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()}
    assert kept == set(brute_labels(texts))


def test_no_rows(spark, documents):
    assert P.near_dedup(spark, documents([]), "").count() == 0


def test_rows_of_one_id(spark, documents, tmp_path):
    """Each row has its own verdict, whatever its id."""
    one, two, leak, free = (" ".join(f"{name}{i}" for i in range(40)) for name in ("one", "two", "leak", "free"))
    rows = [(1, one), (5, two), (5, one), (7, two), (8, free), (8, free), (None, free), (None, leak), (9, leak), (None, "alone")]
    documents(rows).coalesce(1).write.parquet(f"{tmp_path}/docs")
    kept = sorted((str(r.doc_id), r.text) for r in P.near_dedup(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect())
    assert kept == sorted([("1", one), ("5", two), ("8", free), ("9", leak), ("None", "alone")])
    documents([(5, two), (5, leak), (None, leak), (None, one)]).coalesce(1).write.parquet(f"{tmp_path}/mixed")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = P.decontamination(spark, spark.read.parquet(f"{tmp_path}/mixed"), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in clean) == sorted([("5", two), ("None", one)])


def test_boilerplate(spark, documents):
    """Nearly all texts share a long passage, so that buckets are full of strangers; no pair may be lost among them."""
    rng = random.Random(9)
    shared = [f"b{i}" for i in range(170)]
    texts = []
    for _ in range(120):
        own = [f"o{rng.randrange(10**6)}" for _ in range(30)]
        text = shared[:85] + own + shared[85:]
        texts += [" ".join(text), " ".join(edited(rng, text, 3))]
    rows = documents(list(enumerate(texts))).withColumnRenamed("doc_id", "row")
    got = {r.row: r.label for r in N.components(rows).collect()}
    want, names = brute_labels(texts), {}
    assert all(names.setdefault(got[i], want[i]) == want[i] for i in range(len(texts)))
    assert len(names) == len(set(want)) > 40


def test_stages_keep_clashing_columns(spark, documents, tmp_path):
    """Columns named like those that the operators add survive every stage that returns documents."""
    names = ("row", "score", "kept", "ids", "n_lines", "body", "label", "doc", "file", "c0")
    rows = [(i, f"some line of words number {i % 3}\nand another line {i} of this text") for i in range(9)]
    docs = documents(rows)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("doc_id")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, given, str(tmp_path))
        assert out.columns == given.columns, name
        for r in out.collect():
            assert [r[n] for n in names] == [f"{i}:{r.doc_id}" for i in range(len(names))], name
