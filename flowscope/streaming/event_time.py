"""Sliding histogram entropy per entity in the order of event time, on a stream whose rows arrive out of order.

A row waits in the state of its bucket of entities until the watermark has passed it; the rows that have come due are then
taken in order and emitted. An entity without rows for ``idle`` leaves no state; should it come back, its window starts anew.
Rows that arrive behind the watermark are dropped. State lives in RocksDB, so that the session needs that provider.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from flowscope.functions.columns import quoted
from flowscope.operators.windows import histogram_bin
from flowscope.streaming.sliding import STATE_PROVIDER, sliding_entropies

# Rows of a part of the state that wait together.
WAITING_ROWS = 65_536


class OrderedEntropy(StatefulProcessor):
    """State per bucket of entities: rows that wait for the watermark, as Arrow tables, and for each entity the bins of its
    last ``window - 1`` rows and the time of the last one."""

    def __init__(self, columns: Sequence[str], schema: pa.Schema, kept: Sequence[str], window: int, bins: int, idle_ms: int):
        # Columns of a waiting row: the entity as a string, the time in microseconds, the order and kept columns, the bin.
        self.columns, self.schema, self.kept = list(columns), schema, list(kept)
        self.window, self.bins, self.idle_ms = window, bins, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType().add("rows", T.BinaryType()))
        bins = T.StructType().add("entities", T.ArrayType(T.StringType())).add("ends", T.ArrayType(T.IntegerType())).add("bins", T.ArrayType(T.IntegerType()))
        self.recent = handle.getValueState("recent", bins)
        self.last = handle.getValueState("last", T.StructType().add("at", T.ArrayType(T.LongType())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = []
        for frame in rows:
            frame.columns = self.columns
            fresh.append(self.table(frame[frame["_at"] > mark]))
        yield from self.due(mark, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.due(timerValues.getCurrentWatermarkInMs() * 1000, [])

    def table(self, frame: pd.DataFrame) -> pa.Table:
        return pa.Table.from_pandas(frame[self.schema.names], self.schema, preserve_index=False)

    def packed(self, rows: pa.Table) -> list[tuple[bytes]]:
        out = []
        for start in range(0, rows.num_rows, WAITING_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as stream:
                stream.write_table(rows.slice(start, WAITING_ROWS).combine_chunks())
            out.append((sink.getvalue().to_pybytes(),))
        return out

    def due(self, mark: int, fresh: list[pa.Table]) -> Iterator[pd.DataFrame]:
        """Emit the rows that the watermark has passed, and see to it that the others, or the state's end, come up."""
        held = [pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get()] if self.waiting.exists() else []
        rows = pa.concat_tables([self.schema.empty_table(), *held, *fresh])
        at = rows["_at"].to_numpy()
        ready, left = rows.filter(pa.array(at <= mark)), rows.filter(pa.array(at > mark))
        known, times = (self.recent.get(), self.last.get()[0]) if self.recent.exists() else (([], [], []), [])
        ends = np.array(known[1], dtype=np.int64)
        of, codes = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), np.array(known[2], dtype=np.int64)
        number, last = {e: i for i, e in enumerate(known[0])}, np.array(times, dtype=np.int64)
        if ready.num_rows:
            # The tail of each entity, then its new rows in order.
            frame = ready.to_pandas()
            entities = [None if pd.isna(e) else e for e in frame["_entity"]]
            frame["_number"] = [number.setdefault(e, len(number)) for e in entities]
            frame = frame.sort_values(["_number", *self.schema.names[1:]], kind="stable")
            before, new = len(of), frame["_number"].to_numpy(dtype=np.int64)
            of, codes = np.concatenate([of, new]), np.concatenate([codes, frame["_bin"].to_numpy(dtype=np.int64)])
            line = np.argsort(of, kind="stable")
            of, codes = of[line], codes[line]
            sizes = np.bincount(of, minlength=len(number))
            place = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
            values = np.where(place >= self.window - 1, sliding_entropies(codes, self.window, self.bins, 0), np.nan)
            out = frame[["_entity", *self.kept]].copy()
            out["entropy"] = values[line >= before]
            tail = place >= sizes[of] - (self.window - 1)
            of, codes = of[tail], codes[tail]
            last = np.concatenate([last, np.full(len(number) - len(last), -1)])
            np.maximum.at(last, new, frame["_at"].to_numpy())
        if ready.num_rows:
            self.waiting.clear()
        unwritten = [left] if ready.num_rows else fresh
        for rows in unwritten:
            if rows.num_rows:
                self.waiting.appendList(self.packed(rows))
        # Entities of whom no row waits and that have been idle leave no state.
        waits = np.zeros(len(number), dtype=bool)
        waits[[number[e] for e in left["_entity"].unique().to_pylist() if e in number]] = True
        until = last // 1000 + self.idle_ms
        stays = waits | (until * 1000 > mark)
        if ready.num_rows or not stays.all():
            if stays.any():
                keep = stays[of]
                counts = np.bincount(of[keep], minlength=len(number))[stays]
                names = [e for e, s in zip(number, stays, strict=True) if s]
                self.recent.update((names, counts.cumsum().astype(int).tolist(), codes[keep].astype(int).tolist()))
                self.last.update((last[stays].tolist(),))
            else:
                self.recent.clear()
                self.last.clear()
        comes = [*(until[stays & ~waits].tolist()), *([-(-int(left["_at"].to_numpy().min()) // 1000)] if left.num_rows else [])]
        if comes:
            self.handle.registerTimer(min(comes))
        if ready.num_rows:
            yield out

    def close(self) -> None:
        pass


def event_time_entropy(
    stream: DataFrame,
    entity: str,
    value: str,
    time: str,
    order: Sequence[str],
    kept: Sequence[str],
    delay: str,
    idle_ms: int,
    window: int = 256,
    bins: int = 50,
    buckets: int = 1_024,
) -> DataFrame:
    """``(entity, kept..., entropy)`` of every row that the watermark has passed, ``delay`` behind the latest ``time``.

    Rows of an entity are taken by ``time``, equal times by ``order``; null until an entity has ``window`` rows. ``order`` and
    ``kept`` are numbers or strings. State comes by ``buckets`` of entities that are worked on at once: a call for each entity
    costs far more than its rows. A stream that goes on keeps the number of buckets.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    columns = [c for c in dict.fromkeys([*order, *kept]) if c != entity]
    timed = stream.withColumn("_time", quoted(time).cast("timestamp")).withWatermark("_time", delay)
    rows = timed.select(
        F.pmod(F.xxhash64(quoted(entity)), F.lit(buckets)).alias("_bucket"), quoted(entity).cast("string").alias("_entity"),
        "_time", F.unix_micros("_time").alias("_at"), *map(quoted, columns),
        histogram_bin(quoted(value), bins).cast("int").alias("_bin"),
    ).where(F.col("_at").isNotNull())
    types = {f.name: f.dataType for f in rows.schema}
    waiting = T.StructType([T.StructField(c, types[c]) for c in ("_entity", "_at", *columns, "_bin")])
    schema = T.StructType([T.StructField("_entity", T.StringType()), *(T.StructField(c, types[c]) for c in kept)]).add("entropy", T.DoubleType())
    processor = OrderedEntropy(rows.columns, to_arrow_schema(waiting), kept, window, bins, idle_ms)
    out = rows.groupBy("_bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")
    return out.select(F.col("_entity").cast(stream.schema[entity].dataType).alias(entity), *map(quoted, kept), "entropy")
