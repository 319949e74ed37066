"""SimHash near-duplicates with Golay-code fuzzy keys.

A document's words are its runs of non-blank characters, lower-cased (ASCII); its shingles are all runs of three words,
repeats included. A bit of the fingerprint is set if more than half of the shingle hashes (XXH64, seed 42) have it.
Fingerprints link at ``MAX_BITS`` = 2 or fewer differing bits; a component is what links reach.

1. Documents collapse to distinct fingerprints with their smallest id.
2. A fingerprint is cut into segments of 23, 23 and 18 bits. Two errors leave one segment untouched, and each of the
   others within two errors. The perfect (23, 12) Golay code maps a 23-bit word and its 23 neighbours to one or six
   codewords; two words within two errors have a common neighbour and so a common codeword. A key is an untouched segment
   with a codeword of another, so linked fingerprints share a key for certain.
3. Buckets of at most ``BUCKET`` fingerprints are joined with themselves, and the pairs are verified. In larger buckets
   no pairs are made: their fingerprints meet at the words within one bit of them (two words link if and only if they
   share such a word, and no word has more than 65 fingerprints around it), which is exact as well.
4. Smallest labels spread along the links, with pointer jumping, until nothing changes.

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer than three words are one shingle;
every row of a repeated id gets a row; a null id gets its component's smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import keyed_text, quoted, shuffle_parts, table
from flowscope.plans.registry import query
from flowscope.session import cut_lineage

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BUCKET = 24
STEP = 1 << 14
# x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, generator of the binary Golay code.
GENERATOR = 0xAE3
SEGMENT = 23


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) < SHINGLE:
        return hashed(b" ".join(words))
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[j:] for j in range(SHINGLE)), strict=False))
        hashes = np.fromiter(map(hashed, shingles), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc", "bits"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return keyed_text(df, id_col, text_col).mapInArrow(fingerprints_of, "doc long, bits long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of the words, as polynomials, by the generator."""
    rest = words.astype(np.int64)
    for bit in range(SEGMENT - 1, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def correctable() -> np.ndarray:
    """The only error of three bits or fewer that has each syndrome."""
    bits = [1 << i for i in range(SEGMENT)]
    errors = [0, *bits]
    errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    table = np.zeros(1 << 11, np.int64)
    table[syndrome(np.array(errors))] = errors
    return table


def codewords_near(words: np.ndarray) -> np.ndarray:
    """Per word the indices of the codewords that it and its neighbours decode to; repeats are -1."""
    errors = correctable()
    around = words[:, None] ^ np.array([0, *(1 << i for i in range(SEGMENT))])
    found = np.sort((around ^ errors[syndrome(around)]) >> 11, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = (1 << SEGMENT) - 1
    for batch in batches:
        bits = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        parts = [((bits >> np.uint64(s * SEGMENT)) & np.uint64(low)).astype(np.int64) for s in range(3)]
        near = [codewords_near(parts[0]), codewords_near(parts[1])]
        for untouched, other in ((0, 1), (1, 0), (2, 0)):
            row, at = np.nonzero(near[other] >= 0)
            key = (untouched << 36) | (parts[untouched][row] << 12) | near[other][row, at]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bits[row].view(np.int64))], ["key", "bits"])


def links_in_busy_buckets(members: DataFrame) -> DataFrame:
    """All fingerprints of large buckets, linked through the words within one bit of them."""
    masks = F.array(F.lit(0).cast("long"), *(F.expr(f"shiftleft(1L, {i})") for i in range(64)))
    meeting = members.select("bits", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("bits")))).alias("word"))
    around = meeting.groupBy("word").agg(F.array_sort(F.collect_set("bits")).alias("near")).where(F.size("near") > 1)
    return around.select(F.col("near")[0].alias("a"), F.explode(F.slice("near", 2, 64)).alias("b"))


def links(distinct: DataFrame) -> DataFrame:
    """Links among distinct fingerprints (column ``bits``) that keep every component connected: ``a`` < ``b``."""
    # Fingerprints are few bytes before they multiply: left to itself, the planner puts them into a handful of tasks.
    parts = shuffle_parts(distinct.sparkSession)
    keyed = cut_lineage(distinct.select("bits").repartition(parts).mapInArrow(keys_of, "key long, bits long"))
    sizes = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    small = cut_lineage(keyed.join(sizes.where(f"n <= {BUCKET}"), "key", "left_semi"))
    pairs = small.select("key", F.col("bits").alias("a")).join(small.select("key", F.col("bits").alias("b")), "key")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    busy = keyed.join(sizes.where(f"n > {BUCKET}"), "key", "left_semi").select("bits").distinct().repartition(parts)
    return pairs.unionByName(links_in_busy_buckets(busy)).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that its links reach."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        spread = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        spread = cut_lineage(spread)
        above = spread.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = cut_lineage(spread.join(above, "label", "left").select("node", "was", F.coalesce("top", "label").alias("label")))
        if not labels.where("label < was").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def labelled_bits(docs: DataFrame) -> DataFrame:
    """Distinct ``bits`` with the smallest ``doc`` that has them (``first``) and the ``label`` of their component."""
    distinct = cut_lineage(docs.groupBy("bits").agg(F.min("doc").alias("first")))
    labels = component_labels(links(distinct))
    return distinct.join(labels, distinct["bits"] == labels["node"], "left").select("bits", "first", F.coalesce("label", "bits").alias("label"))


def first_rows(df: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``row_col`` of each component's row that stays: the smallest id, of its rows the first; no id comes last.

    ``row_col`` (long) is distinct. Copies are folded before anything is joined by component.
    """
    place = F.struct(quoted(id_col).isNull().alias("nameless"), quoted(id_col).cast("long").alias("id"), quoted(row_col).cast("long").alias("row"))
    docs = df.select(place.alias("doc"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    found = docs.mapInArrow(fingerprints_of, "doc struct<nameless: boolean, id: long, row: long>, bits long")
    return labelled_bits(found).groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row_col))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc``, ``bits``, ``component`` (smallest id that links reach)."""
    docs = cut_lineage(fingerprints(df, id_col, text_col))
    labelled = cut_lineage(labelled_bits(docs))
    smallest = cut_lineage(labelled.groupBy("label").agg(F.min("first").alias("component")))
    known = cut_lineage(labelled.join(smallest, "label").select("bits", "component"))
    return docs.join(known, "bits").select("doc", "bits", "component")


@query("op8_simhash_golay")
def op8_simhash_golay(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
