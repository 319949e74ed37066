"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscope.operators.index import checked_broadcast
from flowscope.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as ``doc``, long) and the text (as ``body``, null becomes empty); other columns cannot clash."""
    return df.select(quoted(id_col).cast("long").alias("doc"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def reads_files_only(df: DataFrame) -> bool:
    """Whether every row of ``df`` is a row of a Parquet file: chosen columns and filters over a scan, nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        if plan.nodeName() == "Project" and "monotonically_increasing_id" in plan.toString():
            return False
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString()


def with_row_number(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of its own for every row that comes out the same however often and wherever it is computed.

    A table read from files takes the place in the file, and the rows of the files before. How the reader splits files
    depends on the cores that Spark sees at the time, so numbers made by task would not do. Any other frame is written to
    the shared folder with its numbers.
    """
    if not reads_files_only(df):
        return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))
    rows = df.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_in_file"))
    sizes = rows.groupBy(F.col(f"{name}_file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = checked_broadcast(cut_lineage(sizes.select("file", F.coalesce(before, F.lit(0)).alias(f"{name}_start"))))
    placed = rows.join(starts, F.col(f"{name}_file") == F.col("file"))
    return placed.select(*map(quoted, df.columns), (F.col(f"{name}_start") + F.col(f"{name}_in_file")).alias(name))


def shuffle_parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session, which whoever runs it sets by the size of the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole string column and the offsets of its rows, without a copy; the column has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[rows[0] : rows[-1]] if len(rows) else raw, rows - (rows[0] if len(rows) else 0)
