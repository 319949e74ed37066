"""Sliding histogram entropy per entity on a stream: a stateful operator, and micro-batches of windows.

The stateful operator has the lowest latency and keeps one entity's rows of a micro-batch in one
task, together with those of its bucket. The micro-batch form splits a hot entity over tasks by position chunks and suits batches in
which one entity may hold a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from flowscope.functions.columns import quoted
from flowscope.operators.index import checked_broadcast, with_entity_index
from flowscope.operators.windows import histogram_bin, sliding_histogram_entropy
from flowscope.session import scratch_path

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Rows whose bin counts are held at once inside a task.
ROWS_AT_ONCE = 8_192


def sliding_entropies(codes: np.ndarray, window: int, bins: int, skip: int) -> np.ndarray:
    """Entropy at every position from ``skip`` on; NaN while fewer than ``window`` values were seen."""
    out = np.full(len(codes) - skip, np.nan)
    first = max(skip, window - 1)
    for start in range(first, len(codes), ROWS_AT_ONCE):
        end = min(start + ROWS_AT_ONCE, len(codes))
        part = codes[start - window + 1 : end]
        hot = np.zeros((len(part) + 1, bins), dtype=np.int32)
        hot[np.arange(1, len(part) + 1), part] = 1
        upto = hot.cumsum(axis=0)
        counts = (upto[window:] - upto[:-window]).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(counts > 0, counts * np.log2(counts), 0.0).sum(axis=1)
        out[start - skip : end - skip] = np.maximum(np.log2(window) - logs / window, 0.0)
    return out


class SlidingEntropy(StatefulProcessor):
    """State per bucket of entities: the bins of the last ``window - 1`` rows of each entity, nothing else."""

    def __init__(self, columns: Sequence[str], window: int, bins: int, order: Sequence[str], kept: Sequence[str]):
        # Column 0 is the bucket, column 1 the entity as a string, the last one the bin.
        self.columns, self.window, self.bins = list(columns), window, bins
        self.order, self.kept = list(order), list(kept)

    def init(self, handle) -> None:
        schema = T.StructType().add("entities", T.ArrayType(T.StringType())).add("ends", T.ArrayType(T.IntegerType())).add("recent", T.ArrayType(T.IntegerType()))
        self.recent = handle.getValueState("recent", schema)

    def handleInputRows(self, key, rows, timerValues):
        # The rows of one bucket in one micro-batch; their number is bounded by the trigger.
        frame = pd.concat(list(rows), ignore_index=True)
        frame.columns = self.columns
        known = self.recent.get() if self.recent.exists() else ([], [], [])
        entities, ends, before = list(known[0]), np.array(known[1], dtype=np.int64), np.array(known[2], dtype=np.int64)
        number = {e: i for i, e in enumerate(entities)}
        found = [None if pd.isna(e) else e for e in frame[self.columns[1]]]
        frame["_number"] = [number.setdefault(e, len(number)) for e in found]
        frame = frame.sort_values(["_number", *self.order], kind="stable")
        # The tail of each entity, then its new rows.
        of = np.concatenate([np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), frame["_number"].to_numpy(dtype=np.int64)])
        codes = np.concatenate([before, frame[self.columns[-1]].to_numpy(dtype=np.int64)])
        line = np.argsort(of, kind="stable")
        of, codes = of[line], codes[line]
        sizes = np.bincount(of, minlength=len(number))
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(of)) - first[of]
        values = np.where(place >= self.window - 1, sliding_entropies(codes, self.window, self.bins, 0), np.nan)
        keep = place >= sizes[of] - (self.window - 1)
        left = np.bincount(of[keep], minlength=len(number))
        self.recent.update((list(number), left.cumsum().astype(int).tolist(), codes[keep].astype(int).tolist()))
        out = frame[[self.columns[1], *self.kept]].copy()
        out["entropy"] = values[line >= len(before)]
        yield out

    def close(self) -> None:
        pass


def stream_sliding_entropy(
    stream: DataFrame,
    entity: str,
    value: str,
    order: Sequence[str],
    kept: Sequence[str],
    window: int = 256,
    bins: int = 50,
    buckets: int = 1_024,
) -> DataFrame:
    """``(entity, kept..., entropy)`` per row of a stream; null until an entity has ``window`` rows.

    Rows of an entity are taken in ``order`` inside a micro-batch. State lives in RocksDB, by ``buckets`` of entities that are
    worked on at once: a call for each entity costs far more than its rows. A stream that goes on keeps the number of buckets.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    columns = [c for c in dict.fromkeys([*order, *kept]) if c != entity]
    rows = stream.select(
        F.pmod(F.xxhash64(quoted(entity)), F.lit(buckets)).alias("_bucket"), quoted(entity).cast("string").alias("_entity"),
        *[quoted(c) for c in columns], histogram_bin(quoted(value), bins).cast("int").alias("_bin"),
    )
    types = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType().add("_entity", T.StringType())
    for c in kept:
        schema = schema.add(c, types[c])
    schema = schema.add("entropy", T.DoubleType())
    processor = SlidingEntropy(rows.columns, window, bins, [c for c in order if c != entity], kept)
    out = rows.groupBy("_bucket").transformWithStateInPandas(processor, schema, "append", "none")
    return out.select(F.col("_entity").cast(stream.schema[entity].dataType).alias(entity), *map(quoted, kept), "entropy")


def batch_sliding_entropy(
    stream: DataFrame,
    entity: str,
    value: str,
    order: Sequence[str],
    kept: Sequence[str],
    window: int = 256,
    bins: int = 50,
) -> tuple[DataFrame, StreamingQuery]:
    """The same result through the batch window operator, one micro-batch after the other.

    Between batches only the last ``window - 1`` rows of every entity are kept, in a table per batch
    in the shared folder. A batch that runs again overwrites its own output and tail.
    """
    spark = stream.sparkSession
    out, tails, state = (scratch_path(spark, n) for n in ("entropy", "entropy-tail", "entropy-state"))
    columns = list(dict.fromkeys([entity, *order, *kept, value]))
    rows = stream.select(*[quoted(c) for c in columns])

    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("_new", F.lit(1))
        if batch_id > 0:
            known = batch.sparkSession.read.schema(T.StructType([*rows.schema.fields]))
            fresh = known.parquet(f"{tails}/batch={batch_id - 1}").withColumn("_new", F.lit(0)).unionByName(fresh)
        placed = with_entity_index(fresh, [entity], ["_new", *order], "_pos", unique=True)
        done = sliding_histogram_entropy(placed, "_pos", value, window, bins, [entity])
        done.filter("_new = 1").select(
            quoted(entity), *[quoted(c) for c in kept if c != entity], "entropy"
        ).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        ends = placed.groupBy(quoted(entity)).agg(F.max("_pos").alias("_end"))
        tail = placed.join(checked_broadcast(ends), entity).filter(F.col("_pos") > F.col("_end") - (window - 1))
        tail.select(*[quoted(c) for c in columns]).write.mode("overwrite").parquet(f"{tails}/batch={batch_id}")

    query = (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    types = {f.name: f for f in rows.schema}
    schema = T.StructType([types[entity], *[types[c] for c in kept if c != entity]]).add("entropy", T.DoubleType())
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out), query
