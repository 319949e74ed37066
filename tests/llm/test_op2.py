import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from flowscope.llm import op2_tokens as T

PATH = public_tokenizers.path(T.VOCABULARY)


def expected(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in entry.queries()["op2_token_counts"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d, n in zip(docs, expected([d.text for d in docs]), strict=True):
        r = rows[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 512)


def test_odd_texts(spark, documents):
    rng = random.Random(5)
    alphabet = list("ab Z09'\t\n\r.,!<|>_") + ["'s", "'ll", "<|endoftext|>", " ", "\u0085", " ", "　", "\u001c", "é", "ß", "日", "😀", "́", "²", "Ⅷ", "\u0000", "  ", "٣"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += [None, "", " ", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "word " * 20_000, "a" * 50_000]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "no id")]
    df = documents(rows).withColumn("words", F.lit("clash"))
    got = sorted((r.doc if r.doc is not None else -1, r.n_bytes, r.n_tokens) for r in T.token_counts(df, PATH).collect())
    want = sorted((i if i is not None else -1, len((t or "").encode()), n) for (i, t), n in zip(rows, expected([t for _, t in rows]), strict=True))
    assert got == want


def test_no_rows(spark, documents):
    assert T.token_counts(documents([]), PATH).count() == 0
