"""Line dedup: two Bloom filters per shard of line digests find the suspects, which alone are confirmed exactly.

A line's key is the line stripped of blanks and lower-cased (ASCII). A key of at least ``min_chars`` code points that at
least two documents hold loses all its lines except in the smallest document that holds it.

1. Each task takes the distinct keys of each document as 128-bit digests. A digest that two documents of the same task
   hold is a suspect at once; of all others one entry (digest, document) goes to the shard of the digest, so that a very
   common line sends one entry per task, not one per document. Entries name the row besides the document.
2. A shard streams its entries through two Bloom filters, seen once and seen twice, then tests each entry against the
   second. Entries that fail are settled: no other task holds their key. Only suspects go on.
3. Suspects are confirmed by exact grouping of their digests (smallest and largest document), which combines in the map
   tasks. The rows that lose a line are joined to their own digests, so that many rows of one id, or of none, share no
   list; AQE splits the join at a hot digest.

Defined cases: a null or empty text is one empty line. A null id counts as one document after all others. Rows that
repeat an id are one document: each is filtered by what the id loses. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import quoted, shuffle_parts, table, with_row_number
from flowscope.plans.registry import query
from flowscope.session import cut_lineage

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
BITS_PER_ENTRY = 12
PROBES = 4
# Entries a task holds before it hands them on; bounds its memory.
HELD = 1_000_000
# Digests are read as big-endian numbers, so that their bytes come back in order.
PART = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("state", "u1")])
# States of an entry: an ordinary document, the document without an id, a digest that its task has settled as a suspect.
PLAIN, NO_ID, REPEATED = 0, 1, 2


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def digest_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_entries(batches: Iterator[pa.RecordBatch], shards: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows of (shard, packed entries); shard -1 carries suspects that the task has found itself."""
    held: list[bytes] = []
    # Document, row and number of digests of each row held.
    whose: list[tuple[int | None, int, int]] = []

    def packed() -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(held), ">u8").astype("<u8").reshape(-1, 2)
        part = np.zeros(len(held), PART)
        part["high"], part["low"] = digests[:, 0], digests[:, 1]
        of = np.repeat(np.arange(len(whose)), [n for _, _, n in whose])
        part["doc"] = np.array([doc or 0 for doc, _, _ in whose], np.int64)[of]
        part["row"] = np.array([row for _, row, _ in whose], np.int64)[of]
        part["state"] = np.array([NO_ID if doc is None else PLAIN for doc, _, _ in whose], np.uint8)[of]
        part = part[np.lexsort((part["low"], part["high"]))]
        again = np.zeros(len(part), bool)
        same = (part["high"][1:] == part["high"][:-1]) & (part["low"][1:] == part["low"][:-1])
        again[1:] |= same
        again[:-1] |= same
        own = part[again]
        first = np.ones(len(own), bool)
        first[1:] = (own["high"][1:] != own["high"][:-1]) | (own["low"][1:] != own["low"][:-1])
        told = own[first].copy()
        told["state"] = REPEATED
        sent = np.concatenate([part[~again], told])
        shard = (sent["high"] % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        sent, shard = sent[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        rows = [(int(s[0]), e.tobytes()) for s, e in zip(np.split(shard, cuts), np.split(sent, cuts), strict=True) if len(s)]
        rows += [(-1, own[at : at + 50_000].tobytes()) for at in range(0, len(own), 50_000)]
        held.clear()
        whose.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "entries"])

    for batch in batches:
        for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc").to_pylist(), batch.column("body"), strict=True):
            keys = {key_of(line) for line in text.as_buffer().to_pybytes().split(b"\n")}
            own = [digest_of(k) for k in keys if long_enough(k, min_chars)]
            held += own
            whose.append((doc, row, len(own)))
            if len(held) >= HELD:
                yield packed()
    if held:
        yield packed()


def twice_seen(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which entries pass the filter of digests seen twice. Both filters stand on the same probes."""
    bits = 1 << int(np.ceil(np.log2(max(64, BITS_PER_ENTRY * len(high)))))
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
    probes = [((high >> np.uint64(8)) + np.uint64(i) * (low | np.uint64(1))) & np.uint64(bits - 1) for i in range(PROBES)]
    step = 1 << 16
    for at in range(0, len(high), step):
        now = [p[at : at + step] for p in probes]
        seen = np.logical_and.reduce([once[p] for p in now])
        # Digests that meet within the step have not seen each other in the filter.
        order = np.lexsort((low[at : at + step], high[at : at + step]))
        h, lo = high[at : at + step][order], low[at : at + step][order]
        seen[order[1:]] |= (h[1:] == h[:-1]) & (lo[1:] == lo[:-1])
        for p in now:
            twice[p[seen]] = True
            once[p] = True
    return np.logical_and.reduce([twice[p] for p in probes])


def shard_suspects(blobs: list[bytes]) -> np.ndarray:
    part = np.frombuffer(b"".join(blobs), PART)
    told = part["state"] == REPEATED
    # What a task has settled itself counts as seen twice.
    high = np.concatenate([part["high"], part["high"][told]])
    low = np.concatenate([part["low"], part["low"][told]])
    return part[twice_seen(high, low)[: len(part)] & ~told]


def unpacked(part: np.ndarray) -> pa.RecordBatch:
    docs = pa.array(part["doc"].astype(np.int64), mask=part["state"] == NO_ID)
    numbers = [pa.array(np.ascontiguousarray(part[c]).view(np.int64)) for c in ("row", "high", "low")]
    return pa.RecordBatch.from_arrays([docs, *numbers], ["doc", "row", "high", "low"])


SUSPECT = "doc long, row long, high long, low long"


def suspects_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards come whole and one after the other (sorted); own suspects pass straight through."""
    now, blobs = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard < 0:
                yield unpacked(np.frombuffer(blob, PART))
                continue
            if shard != now and blobs:
                yield unpacked(shard_suspects(blobs))
                blobs = []
            now = shard
            blobs.append(blob)
    if blobs:
        yield unpacked(shard_suspects(blobs))


def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_lines, n_dropped = [], [], []
        for text, lost in zip(batch.column("body"), batch.column("lost").to_pylist(), strict=True):
            lines = text.as_buffer().to_pybytes().split(b"\n")
            n_lines.append(len(lines))
            if lost:
                gone = set(lost)
                lines = [line for line in lines if digest_of(key_of(line)) not in gone]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(b"\n".join(lines).decode())
        carried = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("body", "lost")]
        names = [name for name in batch.schema.names if name not in ("body", "lost")]
        yield pa.RecordBatch.from_arrays([*carried, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "kept", "n_lines", "n_dropped"])


def lost_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Of rows (``row``, ``doc``, ``body``) those that lose lines: ``lost_row`` and the digests of the keys it loses, ``lost``."""
    spark = rows.sparkSession
    shards = shuffle_parts(spark)
    entries = rows.select("row", "doc", "body").mapInArrow(lambda it: line_entries(it, shards, min_chars), "shard int, entries binary")
    # Own suspects stay spread; shards are small rows of packed entries.
    target = F.when(F.col("shard") < 0, F.pmod(F.xxhash64("entries"), F.lit(shards)).cast("int")).otherwise(F.col("shard"))
    dealt = entries.repartition(shards, target).sortWithinPartitions("shard")
    suspects = cut_lineage(dealt.mapInArrow(suspects_of, SUSPECT))
    confirmed = suspects.groupBy("high", "low").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("open"))
    confirmed = cut_lineage(confirmed.where("first IS NOT NULL AND (first < last OR open)").select("high", "low", "first"))
    digest = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("high", "low"))))
    lost = suspects.join(confirmed, ["high", "low"]).where("doc IS NULL OR doc > first").select("row", digest.alias("digest"))
    return lost.groupBy(F.col("row").alias("lost_row")).agg(F.collect_list("digest").alias("lost"))


def with_lines_deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of ``df`` with ``kept`` (the text without its repeated lines), ``n_lines`` and ``n_dropped``."""
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*(quoted(c).alias(n) for c, n in zip(keep, names, strict=True)), quoted(id_col).cast("long").alias("doc"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    rows = with_row_number(rows, "row")
    joined = rows.join(lost_lines(rows, min_chars), F.col("row") == F.col("lost_row"), "left").select(*names, "body", "lost")
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    out = joined.mapInArrow(filtered, f"{kinds}{', ' if kinds else ''}kept string, n_lines long, n_dropped long")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "kept", "n_lines", "n_dropped")


KEY_SQL = r"""translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, {KEY_SQL} AS key FROM numbered),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op3_line_dedup", SQL)
def op3_line_dedup(spark, sf_dir):
    out = with_lines_deduplicated(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
