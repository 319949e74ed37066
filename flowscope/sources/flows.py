"""Reading flow tables: Parquet sets, labelled file sets, CSV, side columns, cached preparations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.functions import columns as C
from flowscope.functions.columns import quoted
from flowscope.operators import stats as S

# The numeric columns of a connection log, in file order.
CONNECTION_COLUMNS = (
    "duration", "orig_bytes", "resp_bytes", "missed_bytes",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
    "proto_icmp", "proto_tcp", "proto_udp",
    "conn_state_OTH", "conn_state_REJ", "conn_state_RSTO", "conn_state_RSTOS0",
    "conn_state_RSTR", "conn_state_RSTRH", "conn_state_S0", "conn_state_S1",
    "conn_state_S2", "conn_state_S3", "conn_state_SF", "conn_state_SH", "conn_state_SHR",
)

# The named feature sets over a connection log.
FEATURE_SETS = {
    "Default": (
        "orig_pkts", "orig_ip_bytes", "conn_state_OTH", "duration",
        "conn_state_S0", "missed_bytes", "orig_bytes", "proto_tcp",
        "proto_udp", "resp_ip_bytes", "proto_icmp",
    ),
    "A": (
        "orig_ip_bytes", "orig_pkts", "conn_state_S0", "conn_state_OTH",
        "duration", "orig_bytes", "resp_bytes", "proto_tcp", "proto_udp",
    ),
    "B": ("orig_ip_bytes", "orig_pkts", "conn_state_S0", "conn_state_OTH", "duration"),
}

# Candidate names of the packet length column, best first.
LENGTH_COLUMNS = (
    "Total Length of Fwd Packets", "Fwd Packet Length Mean", "Packet Length", "Length",
)


def connection_schema(label: str = "Label") -> T.StructType:
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in CONNECTION_COLUMNS])
    return schema.add(label, T.StringType())


def load_flows(spark: SparkSession, base: str, files: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Union by name of several Parquet files or folders; missing columns become null."""
    names = list(files.values()) if isinstance(files, Mapping) else list(files)
    root = base.rstrip("/")
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{n}" for n in names])


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name of tables from different sources."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def file_label(separator: str = "-"):
    """The file name up to the first separator, without its extension."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z0-9]+$", "")
    return F.split_part(stem, F.lit(separator), F.lit(1))


def labelled_scan(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: T.StructType | None = None, name: str = "Label"
) -> DataFrame:
    """All files under ``folder`` that match, labelled by file name. Unreadable files are skipped;
    it is an error when none match."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", pattern)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.parquet(folder)
    except AnalysisException as error:
        raise FileNotFoundError(f"no readable file matches {pattern} in {folder}") from error
    if not len(df._jdf.inputFiles()):
        raise FileNotFoundError(f"no file matches {pattern} in {folder}")
    return df.select("*", file_label().alias(name))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV with a declared schema, split into blocks by Spark (``spark.sql.files.maxPartitionBytes``)."""
    return spark.read.schema(schema).option("header", str(header).lower()).csv(path)


def integers_as_double(schema: T.StructType) -> T.StructType:
    """The schema with every integer column widened, for files that hold gaps in integer columns."""
    wide = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return T.StructType(
        [T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, wide) else f.dataType) for f in schema]
    )


def load_indexed_csv(
    spark: SparkSession, path: str, schema: T.StructType, index: str, label: str = "Label", positive: str = C.ATTACK
) -> tuple[DataFrame, S.Scaler]:
    """CSV whose first column is the row index: scaled features, label and a 0/1 label ``y``."""
    df = scan_csv(spark, path, schema).withColumnRenamed(index, "row_idx")
    features = [f.name for f in schema if f.name not in (index, label)]
    scaler = S.fit_standard_scaler(df, features)
    scaled = scaler.transform(df).withColumn("y", C.label_bit(quoted(label), positive))
    return scaled, scaler


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next(iter(present(df, candidates)), None)


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in present(df, wanted)])


def prefix(df: DataFrame, n: int, idx: str) -> DataFrame:
    """The first ``n`` rows by position: a filter, not a sort. See ``file_prefix`` for one that reads only what it keeps."""
    return df.filter(F.col(idx) < n)


def file_prefix(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` rows of a Parquet file set in path order: only the files that hold them are read.

    The counts per file come from the footers. The files of a prefix are bounded by ``n``; each is cut
    at its own row number.
    """
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("before", before).filter(F.col("before") < n).orderBy("file").collect()
    if not wanted:
        return spark.read.parquet(path).limit(0)
    whole = [r.file for r in wanted if r.before + r.n <= n]
    out = spark.read.parquet(*whole) if whole else None
    for r in wanted:
        if r.before + r.n > n:
            rows = spark.read.parquet(r.file)
            part = rows.filter(F.col("_metadata.row_index") < n - r.before)
            out = part if out is None else out.unionByName(part)
    return out


def attach_by_index(df: DataFrame, side: DataFrame, idx: str, how: str = "inner") -> DataFrame:
    """Bring a per-row side column in by key; with ``inner`` unmatched rows go."""
    return df.join(side, idx, how)


def materialise_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the prepared table at ``path``, or build and write it first.

    Only a finished write counts: Spark leaves ``_SUCCESS`` when the last task has committed.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
