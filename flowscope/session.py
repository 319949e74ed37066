"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "flowscope", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may do without that
    setting and gets a temporary folder; executors elsewhere would not see such a folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="flowscope-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Of the files. Rows that are kept for many scans, with arrays and vectors, take some thirty times as much.
BYTES_PER_PART = 8 << 20
# The planner reports an absurd size where it knows none.
UNKNOWN_BYTES = 1 << 60
# Bytes of a checkpoint for one byte of a file with the same rows.
CHECKPOINT_TIMES = 6


def checkpoint_bytes(df: DataFrame, leaf) -> int | None:
    """Size of the checkpoint that a leaf of a plan reads; None for any other leaf."""
    if leaf.nodeName() != "LogicalRDD" or not leaf.rdd().getCheckpointFile().isDefined():
        return None
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(leaf.rdd().getCheckpointFile().get())
    return int(path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength())


def known_bytes(df: DataFrame) -> int:
    """Size of the tables below ``df`` as far as the planner knows it; of checkpoints, which it guesses from what made them, as written."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for leaf in map(leaves.apply, range(leaves.size())):
        written = checkpoint_bytes(df, leaf)
        size = int(str(leaf.stats().sizeInBytes())) if written is None else -(-written // CHECKPOINT_TIMES)
        total += size if size < UNKNOWN_BYTES else 0
    return total


def parts_for(df: DataFrame, at_least: int | None = None) -> int:
    """Parts of a kept table: by the size of the source tables, and at least ``at_least`` or the number of cores."""
    return max(at_least or df.sparkSession.sparkContext.defaultParallelism, -(-known_bytes(df) // BYTES_PER_PART))


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Deal rows evenly to all cores, once, before a table is kept and scanned many times.

    The number of parts follows the size of the source tables and is at least ``at_least``, by itself the number of cores.
    A table that already comes in enough files is left as it is.
    """
    parts = parts_for(df, at_least)
    if len(df._jdf.inputFiles()) >= parts:
        return df
    return df.repartition(parts)
