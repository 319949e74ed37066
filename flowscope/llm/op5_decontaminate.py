"""Benchmark decontamination by winnowing.

A word is a run of letters, digits and non-ASCII characters, lower-cased (ASCII). A window is ``WINDOW`` consecutive
words of a benchmark item (an item of fewer words is one window). Words of a document inside an occurrence of a window
are hit.

Both sides keep, of every ``WINDOW - GRAM + 1`` consecutive ``GRAM``-gram hashes, the smallest (the last of equals).
Text shared over ``WINDOW`` words therefore shares a kept hash at the same place. Items shorter than a window are looked
up by one hash of their whole length at every position.

1. The items' hashes are set in a bit filter of fixed size, which every task gets.
2. One scan of the documents counts words, winnows, and keeps the hashes that pass the filter, each with the words around
   it as far as a window can reach. Other hashes never leave the task.
3. The kept hashes are joined to the items' hashes, compared word by word, and extended to both sides. An extension of a
   window's length or more is a hit; the union of its hits is counted per document.

Words are compared by 64-bit hashes. Defined cases: a null or empty text has no words, no hits and is clean; a null or
empty item has no windows; every row of a repeated id gets its own result; items that repeat count each by its id; empty
tables give an empty result, or documents without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import quoted, table, text_buffers
from flowscope.plans.registry import query
from flowscope.session import cut_lineage

WINDOW = 13
GRAM = 8
FILTER_BITS = 1 << 24
SLICE = 1 << 20
U = np.uint64
NONE = U(0xFFFFFFFFFFFFFFFF)


def odd_powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, base, U)]), dtype=U)


PLACE = odd_powers(1 << 12, 0x9E3779B97F4A7C15)
ROLL = odd_powers(64, 0xD6E8FEB86659FD93)

# Bytes of words stand for themselves, lower-cased; all others are 0.
LOWERED = np.zeros(256, np.uint8)
LOWERED[128:] = np.arange(128, 256)
LOWERED[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
LOWERED[ord("a") : ord("z") + 1] = LOWERED[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all rows, and the number of words of each row."""
    code = LOWERED[raw]
    inside = code > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, U), counts
    reach = np.diff(np.append(starts, len(raw)))
    # Place within the word; what stands before the first word counts as nothing.
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, reach)
    weight = PLACE[place & (len(PLACE) - 1)]
    block = place >> 12
    if block.max() > 0:
        weight = weight * odd_powers(int(block.max()) + 1, int(PLACE[-1] * PLACE[1]))[block]
    value = code[starts[0] :].astype(U) * weight
    return mixed(np.add.reduceat(value, starts - starts[0])), counts


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(size):
        total += words[j : j + n] * ROLL[j]
    return np.minimum(mixed(total), NONE - U(1))


def winnowed(words: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that winnowing keeps; windows do not cross rows."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    hashes, span = grams(words, GRAM), WINDOW - GRAM + 1
    least, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        now = hashes[j : j + n]
        less = now <= least
        least[less] = now[less]
        at[less] = j
    whole = row_of[:n] == row_of[WINDOW - 1 :]
    kept = np.unique((np.arange(n) + at)[whole])
    return kept, hashes[kept]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about SLICE bytes: first and last row, words and the number of words of each row."""
    raw, offsets = text_buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, to, *word_hashes(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def around(words: np.ndarray, low: int, high: int, pos: int, size: int) -> tuple[list[int], list[int], list[int]]:
    """Words before (nearest first), inside and after the gram, as far as a window can reach."""
    reach = WINDOW - size
    signed = words.view(np.int64)
    return signed[max(low, pos - reach) : pos][::-1].tolist(), signed[pos : pos + size].tolist(), signed[pos + size : min(high, pos + size + reach)].tolist()


SEED = "array<struct<size:int,hash:long,pos:int,before:array<long>,inside:array<long>,after:array<long>>>"
SEED_ARROW = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32()), ("before", pa.list_(pa.int64())), ("inside", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))]))


def slot(hashes: np.ndarray, size: int) -> np.ndarray:
    return ((hashes >> U(20)) + U(size) * U(0x9E3779B1)) % U(FILTER_BITS)


def seeds_of(batches: Iterator[pa.RecordBatch], short: list[int], flags: np.ndarray | None, whole: bool) -> Iterator[pa.RecordBatch]:
    """Words and seeds of each row. With ``whole`` (items) a short row is one gram; ``flags`` keeps what the filter knows."""
    for batch in batches:
        counted, seeds = [], []
        for at, to, words, counts in slices(batch, "body"):
            ends = np.cumsum(counts)
            row_of = np.repeat(np.arange(to - at), counts)
            found = [(GRAM, *winnowed(words, row_of))]
            for size in short:
                hashes = grams(words, size)
                ok = row_of[: len(hashes)] == row_of[size - 1 :] if len(hashes) else np.zeros(0, bool)
                if whole:
                    ok &= counts[row_of[: len(hashes)]] == size
                found.append((size, np.flatnonzero(ok), hashes[ok]))
            rows: list[list] = [[] for _ in range(to - at)]
            for kind, (size, pos, hashes) in enumerate(found):
                # Short windows are told apart from grams of windows by a negative size.
                name = -size if kind else size
                if flags is not None:
                    s = slot(hashes, kind and size)
                    keep = (flags[s >> U(3)] >> (s & U(7)).astype(np.uint8)) & 1 > 0
                    pos, hashes = pos[keep], hashes[keep]
                for p, h in zip(pos.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    r = int(row_of[p])
                    high = int(ends[r])
                    low = high - int(counts[r])
                    if kind:
                        before, inside, after = [], words[p : p + size].view(np.int64).tolist(), []
                    else:
                        before, inside, after = around(words, low, high, p, size)
                    rows[r].append({"size": name, "hash": h, "pos": p - low, "before": before, "inside": inside, "after": after})
            counted += counts.tolist()
            seeds += rows
        carried = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "body"]
        names = [n for n in batch.schema.names if n != "body"]
        yield pa.RecordBatch.from_arrays([*carried, pa.array(counted, pa.int64()), pa.array(seeds, SEED_ARROW)], [*names, "n_words", "seeds"])


def lengths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.concatenate([c for _, _, _, c in slices(batch, "body")] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(counts), pa.int64())], ["n"])


def item_seeds(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """One row per kept hash of an item, and the lengths of items shorter than a window (at most WINDOW - 1 of them)."""
    bodies = items.select(quoted(item_col).cast("string").alias("item"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    lengths = bodies.select("body").mapInArrow(lengths_of, "n long").where(f"n BETWEEN 1 AND {WINDOW - 1}").distinct()
    short = sorted(r.n for r in lengths.collect())
    seeds = bodies.mapInArrow(lambda it: seeds_of(it, short, None, True), f"item string, n_words long, seeds {SEED}")
    return cut_lineage(seeds.select("item", F.explode("seeds").alias("i")).select("item", "i.*")), short


def filter_of(seeds: DataFrame) -> np.ndarray:
    """Bit filter over all hashes of the items: FILTER_BITS / 64 words at most, whatever the number of items."""
    # The same slots as slot(), in the JVM: unsigned shift, then a remainder by a power of two.
    place = (F.shiftrightunsigned("hash", 20) + F.when(F.col("size") < 0, -F.col("size")).otherwise(0) * F.lit(0x9E3779B1)).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = seeds.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b"))
    flags = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        flags[r.w] = r.b
    return flags.view(np.uint8)


# Leading equal words of two contexts.
def agreed(a: str, b: str):
    same = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(same == 0, F.size(a)).otherwise(same - 1).cast("int")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: ``doc``, ``n_words``, ``n_hit``, the sorted ids of the items with hits, ``contaminated``."""
    spark = docs.sparkSession
    seeds, short = item_seeds(items, item_col, item_text)
    flags = spark.sparkContext.broadcast(filter_of(seeds))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).cast("long").alias("doc"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    scanned = rows.mapInArrow(lambda it: seeds_of(it, short, flags.value, False), f"row long, doc long, n_words long, seeds {SEED}")
    mine = scanned.select("row", "doc", "n_words", F.explode_outer("seeds").alias("d")).select("row", "doc", "n_words", F.col("d.size").alias("d_size"), F.col("d.hash").alias("d_hash"), *(F.col(f"d.{c}").alias(f"d_{c}") for c in ("pos", "before", "inside", "after")))
    joined = mine.join(seeds, (F.col("d_size") == F.col("size")) & (F.col("d_hash") == F.col("hash")) & (F.col("d_inside") == F.col("inside")), "left")
    start, end = F.col("d_pos") - agreed("d_before", "before"), F.col("d_pos") + F.abs("size") + agreed("d_after", "after")
    spans = joined.select("row", "doc", "n_words", "item", start.alias("start"), end.alias("end"), "size")
    hit = F.col("item").isNotNull() & ((F.col("size") < 0) | (F.col("end") - F.col("start") >= WINDOW))
    # The same span of many items counts once.
    found = spans.groupBy("row").agg(
        F.first("doc").alias("doc"),
        F.first("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.collect_set(F.when(hit, F.col("item")))).alias("items"),
    )
    union = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
        lambda a: a["n"],
    )
    out = found.select("doc", "n_words", union.alias("n_hit"), "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


SQL = f"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
windows AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + least({WINDOW}, len(w))], ' ') AS win, least({WINDOW}, len(w)) AS size
            FROM (SELECT item_id, w, unnest(range(len(w) - least({WINDOW}, len(w)) + 1)) AS s FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS s FROM doc_words, sizes WHERE len(w) >= size),
hits AS (SELECT p.doc_id, p.s, p.size, x.item_id FROM (SELECT doc_id, s, size, array_to_string(w[s + 1 : s + size], ' ') AS win FROM places) p JOIN windows x ON x.win = p.win AND x.size = p.size),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op5_decontaminate", SQL)
def op5_decontaminate(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
