"""From raw documents to training segments: quality, repeated lines, near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns a DataFrame; all but
the last return the columns of documents. A stage's result is written as Parquet under the shared folder and read again,
so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm import op3_lines, op5_decontaminate, op6_quality, op8_simhash, op10_sentencepiece
from flowscope.llm.common import table, with_row_number
from flowscope.plans.registry import QUERIES, query
from flowscope.session import scratch_path

ORACLE_SQL = None
ID, TEXT = "doc_id", "text"
ROW = "row"


def plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with numbered columns, so that no column clashes with one that an operator adds; the new names of id and text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index(ID)], names[docs.columns.index(TEXT)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, takes for good."""
    model = op6_quality.fit(docs.select(ID, TEXT), table(spark, sf_dir, "labels"))
    rows, _, text = plain(docs)
    kept = op6_quality.scored(rows, model, text, keep=(*rows.columns,))
    return kept.where(F.col("score") >= op6_quality.THRESHOLD).select(*rows.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; a document that loses all its lines stays, with an empty text."""
    rows, own, text = plain(docs)
    others = tuple(c for c in rows.columns if c != text)
    kept = op3_lines.with_lines_deduplicated(rows, own, text, keep=others)
    new = {"n_chars": F.length("kept").cast("long"), TEXT: F.col("kept")}
    return kept.select(*(new.get(name, F.col(c)).alias(name) for name, c in zip(docs.columns, rows.columns, strict=True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the SimHash operator: the smallest id, of its rows the first; rows without an id come last."""
    rows, own, text = plain(docs)
    rows = with_row_number(rows, ROW)
    first = op8_simhash.first_rows(rows, ROW, own, text)
    return rows.join(first, ROW, "left_semi").drop(ROW).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark."""
    rows, _, text = plain(docs)
    rows = with_row_number(rows, ROW)
    found = op5_decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), ROW, text)
    return rows.join(found.where("contaminated").select(F.col("doc").alias(ROW)), ROW, "left_anti").drop(ROW).toDF(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, as ids with their inclusion scores."""
    return op10_sentencepiece.segmentations(docs, public_tokenizers.path(op10_sentencepiece.VOCABULARY), ID, TEXT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def register() -> None:
    if "pipeline" not in QUERIES:
        query("pipeline", ORACLE_SQL)(run)
