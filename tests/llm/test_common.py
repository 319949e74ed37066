import numpy as np
from pyspark.sql import functions as F

from flowscope.llm import op3_lines as L
from flowscope.llm import op5_decontaminate as D
from flowscope.llm.common import reads_files_only, with_row_number


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    spark.range(4000).select(F.col("id").alias("row"), F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(3).write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t").toDF("c0", "c1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for size in ("16k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        seen.append({r.c0: r["row"] for r in with_row_number(docs, "row").collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] and sorted(seen[0].values()) == list(range(4000))


def test_row_numbers_of_other_frames(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    twice = table.select("id", F.explode(F.array(F.lit(1), F.lit(2))))
    assert reads_files_only(table.where("id > 3").select("id")) and not reads_files_only(twice) and not reads_files_only(spark.range(3))
    rows = with_row_number(twice, "row")
    assert len({r["row"] for r in rows.collect()}) == 100 and rows.collect() == rows.collect()


def hashes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return D.word_hashes(raw, np.array([0, len(raw)]))[0].tolist()


def test_long_words_hash_by_all_their_bytes():
    x, y = "x" * 4096, "y" * 4096
    words = [x + y, y + x, x + x, x, y + y + x, y + x + y, x + y + y]
    assert len({hashes(w)[0] for w in words}) == len(words)
    assert hashes(f"ab {x + y} cd") == hashes("ab") + hashes(x + y) + hashes("cd")


def test_rows_without_an_id_keep_lists_of_their_own(spark, documents):
    """The rows of no id are one document, but a row is joined to the digests of its own lines only."""
    rows = [(1, "\n".join(f"shared line number {i}" for i in range(300)))] + [(None, "\n".join(f"shared line number {i}" for i in range(j, j + 10))) for j in range(0, 290, 10)]
    df = with_row_number(documents(rows).select(F.col("doc_id").alias("doc"), F.col("text").alias("body")), "row")
    lost = L.lost_lines(df).collect()
    assert sorted(len(r.lost) for r in lost) == [10] * 29
