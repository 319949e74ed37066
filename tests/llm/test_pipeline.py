import collections

import corpus_pipeline as P
from flowscope.llm import op5_decontaminate, op6_quality, op8_simhash
from tests.llm.test_op8 import brute_bits, brute_components


def staged(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for name, stage in P.STAGES:
        stage(spark, frames[-1], sf_dir).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    return frames


def brute_lines(rows):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blanks))
    holders = collections.defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            holders[key(line)].add(r.doc_id)
    gone = lambda line, doc: len(key(line)) >= 10 and len(holders[key(line)]) > 1 and doc > min(holders[key(line)])
    return {r.doc_id: "\n".join(line for line in (r.text or "").split("\n") if not gone(line, r.doc_id)) for r in rows}


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    raw, good, lines, near, clean, encoded = staged(spark, sf_dir, tmp_path)
    for frame in (good, lines, near, clean):
        assert frame.columns == raw.columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in (raw, good, lines, near, clean, encoded)]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert ids[1] < ids[0] and sum(labels[i] for i in ids[1] & set(labels)) > 0.95 * sum(labels.values())
    model = op6_quality.fit(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in op6_quality.scored(raw, model, keep=("doc_id",)).collect() if r.score >= 0.7}
    assert {r.doc_id: r.text for r in lines.collect()} == brute_lines(good.collect())
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    components = brute_components({r.doc_id: brute_bits(r.text or "") for r in lines.collect()})
    assert ids[3] == {d for d, c in components.items() if d == c}
    flagged = op5_decontaminate.contamination(near, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert ids[4] == ids[3] - {r.doc for r in flagged.where("contaminated").collect()}
    assert ids[5] == ids[4] and encoded.where("NOT decodes").count() == 0


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns[0] == "doc_id" and out.count() > 0


def test_odd_documents(spark, documents, tmp_path):
    """Nulls, empties, a long text, copies, repeated rows and no labels of one class: every stage runs."""
    folder = f"{tmp_path}/sf"
    rows = [(1, "some ordinary words on a line of text"), (2, None), (3, ""), (4, "some ordinary words on a line of text"), (4, "some ordinary words on a line of text"), (None, "no id"), (5, "long " * 30_000)]
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert {r.doc_id for r in P.run(spark, folder).collect()} == {1, 2, None, 5}
    documents([]).write.parquet(f"{folder}2/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{folder}2/{name}.parquet")
    assert P.run(spark, f"{folder}2").count() == 0


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "encoding"]
    assert op8_simhash.MAX_BITS == 2


def test_near_duplicates_are_those_of_the_simhash_operator(spark, documents, tmp_path):
    """Texts within two bits are one component though only half of their five-word shingles are common; the smallest id stays, of its rows the first."""
    rows = [(9, "alpha beta"), (3, "ALPHA  beta"), (3, "alpha\nbeta"), (None, "alpha beta"), (7, "gamma " * 40), (8, "gamma " * 41 + "delta"), (None, "no id"), (4, None), (5, "")]
    documents(rows).coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = P.near_dedup(spark, docs, str(tmp_path)).collect()
    assert op8_simhash.fingerprint(rows[4][1].encode()) == op8_simhash.fingerprint(rows[5][1].encode())
    assert sorted((r.doc_id or 99, r.text) for r in got) == [(3, "ALPHA  beta"), (4, None), (7, "gamma " * 40), (99, "no id")]
