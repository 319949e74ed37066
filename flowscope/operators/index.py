"""Row positions, halo chunks and distributed running sums.

Spark rows have no order. Everything positional in this package goes through one of these, so that
no window ever runs over the whole table in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscope.session import cut_lineage

# Copies of one row emitted by a single task; longer runs of copies are spread over tasks.
COPIES_PER_TASK = 1_000_000


def with_file_row_index(spark: SparkSession, path: str | list[str], name: str = "row_idx") -> DataFrame:
    """Position of every row in its Parquet file set: no sort and no shuffle of the rows.

    Files are ordered by path; the offset of a file is the number of rows in the files before it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.parquet(*paths).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_in_file"),
    )
    # One row per file: the running sum is over file counts, never over rows.
    per_file = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        rows.join(checked_broadcast(offsets), "_file")
        .withColumn(name, F.col("_offset") + F.col("_in_file"))
        .drop("_file", "_in_file", "_offset")
    )


def with_row_index(
    df: DataFrame, order: Sequence[str], name: str = "row_idx", unique: bool = False
) -> DataFrame:
    """0-based position of every row in the total order ``order``.

    Rows are range-partitioned by the whole ordering tuple, so a hot leading key is split over
    partitions. Positions come from the sorted partitions plus a prefix sum over one row per
    partition. ``unique=False`` first folds identical rows into (row, copies): a third of the table
    being one row costs one row in the sort, and its copies are emitted in bounded pieces.
    """
    columns = list(df.columns)
    if not unique:
        df = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
        order = [*order, *[c for c in columns if c not in order]]
    else:
        df = df.withColumn("_copies", F.lit(1).cast("bigint"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition in its high bits and the position in its low 33 bits. It is only
    # valid for this very sort, hence the lineage cut.
    sorted_rows = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    sizes = sorted_rows.groupBy(part).agg(F.sum("_copies").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rows = sorted_rows.select("*", part)
    if unique or (sorted_rows.agg(F.max("_copies")).first()[0] or 1) == 1:
        low = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
        return rows.join(checked_broadcast(offsets), "_part").select(*columns, (F.col("_offset") + low).alias(name))
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(
        checked_broadcast(offsets), "_part"
    )
    start = F.col("_offset") + F.col("_before")
    placed = placed.select(*columns, "_copies", start.alias("_start"))
    few = placed.filter(F.col("_copies") <= COPIES_PER_TASK).withColumn("_piece", F.lit(0).cast("bigint"))
    many = (
        placed.filter(F.col("_copies") > COPIES_PER_TASK)
        .withColumn(
            "_piece", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(COPIES_PER_TASK)))
        )
        .repartition("_start", "_piece")
    )
    last = F.least(F.col("_copies"), F.col("_piece") + COPIES_PER_TASK) - 1
    return (
        few.unionByName(many)
        .withColumn("_k", F.explode(F.sequence("_piece", last)))
        .select(*columns, (F.col("_start") + F.col("_k")).alias(name))
    )


def with_entity_index(
    df: DataFrame, entity: Sequence[str], order: Sequence[str], name: str = "row_idx", unique: bool = False
) -> DataFrame:
    """0-based position of every row inside its entity.

    Rows are placed by the global order (entity, order), which splits a hot entity over partitions;
    the position is the distance to the entity's first row.
    """
    placed = with_row_index(df, [*entity, *order], "_at", unique)
    starts = placed.groupBy(*entity).agg(F.min("_at").alias("_first"))
    joined = placed.join(checked_broadcast(starts), list(entity))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_at") - F.col("_first")).alias(name))


def with_halo(
    df: DataFrame, idx: str, chunk: int, halo: int
) -> DataFrame:
    """Split a position axis into chunks that also hold the ``halo`` rows before them.

    Adds ``_chunk`` and ``_owned``: a row belongs to one chunk and is borrowed by the next one when
    it lies in the last ``halo`` positions of its own. Positions are dense, so a chunk holds at most
    ``chunk + halo`` rows per entity whatever the data.
    """
    if chunk < max(halo, 1):
        raise ValueError("a chunk must hold at least one halo")
    own = F.expr(f"`{idx}` div {int(chunk)}")
    if halo == 0:
        return df.withColumn("_chunk", own).withColumn("_owned", F.lit(True))
    lends = F.pmod(F.col(idx), F.lit(chunk)) >= chunk - halo
    homes = F.when(lends, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_chunk", F.explode(homes)).withColumn("_owned", F.col("_chunk") == own)


def range_buckets(df: DataFrame, order: str, buckets: int = 512) -> tuple[DataFrame, str]:
    """Add ``_bucket``, a coarse range partition of a numeric column by approximate quantiles.

    The bounds are a list of at most ``buckets`` numbers, so the bucket of a value is a literal
    lookup and every run places it alike.
    """
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(
        F.percentile_approx(F.col(order).cast("double"), probs, 100 * buckets).alias("q")
    ).first()["q"]
    inner = sorted(set(found or []))
    splits = [float("-inf"), *inner, float("inf")]
    df = df.withColumn("_order_d", F.col(order).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol="_order_d", outputCol="_bucket").transform(df)
    return bucketed.drop("_order_d"), "_bucket"


def running_sums(
    df: DataFrame,
    order: str,
    sums: dict[str, Column],
    descending: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums over a table with one row per ``order`` value (per ``by`` key).

    Two levels: inside range buckets in parallel, plus the totals of the buckets before. Use it on
    value counts, where one hot value is one row.
    """
    named = df.withColumns({f"_in_{k}": v for k, v in sums.items()})
    bucketed, bucket = range_buckets(named, order)
    keys = [*by, bucket]
    totals = bucketed.groupBy(*keys).agg(*[F.sum(f"_in_{k}").alias(f"_t_{k}") for k in sums])
    direction = F.col(bucket).desc() if descending else F.col(bucket).asc()
    earlier = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums]
    )
    inner = F.col(order).desc() if descending else F.col(order).asc()
    inside = (
        Window.partitionBy(*keys).orderBy(inner).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = bucketed.join(checked_broadcast(before), keys).select(
        *df.columns, *[(F.sum(f"_in_{k}").over(inside) + F.col(f"_b_{k}")).alias(k) for k in sums]
    )
    return out


def single_row(stats: DataFrame) -> Column:
    """A one-row table as a struct Column (a scalar subquery), for comparing rows with totals."""
    return stats.select(F.struct(*[F.col(f"`{c}`") for c in stats.columns]).alias("_row")).scalar()


def checked_broadcast(small: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast a table once it is known to be small; a larger one is left to a shuffle join.

    At most ``max_rows + 1`` rows or about ``max_bytes`` reach the driver, which proves the bound and
    also computes the table a single time for all its uses.
    """
    rows, size = [], 0
    for row in small.limit(max_rows + 1).toLocalIterator():
        size += sum(len(v) if isinstance(v, (str, bytes, bytearray)) else len(str(v)) for v in row)
        if len(rows) == max_rows or size > max_bytes:
            return small
        rows.append(row)
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))
