"""Near copies by the likeness of word shingles, for the pipeline's near-duplicate stage.

Words are those of the SimHash operator; shingles are all distinct runs of ``SHINGLE`` words (fewer words are one
shingle). Two texts are near copies if the Jaccard likeness of their shingles is ``LEAST`` percent or more; a component
is what near copies reach.

1. One scan gives each row the digest of its shingles (``shape``; copies have the same) and ``BANDS`` keys, each a hash of
   ``ROWS`` minima of the shingles under random mappings. Texts at ``LEAST`` share a key with probability
   1 - (1 - 0.8^4)^16 = 0.9998, more alike ones with a larger one.
2. Shapes that share a key are compared: all pairs in buckets of at most ``BUCKET`` shapes. In a larger bucket all members
   are compared with one of them, the hub. Those in its component (by now, through any bucket) are connected; what links
   may be missing are those of the others, the strangers. If they are few, each is compared with all members, which
   settles the bucket. If they are many, the bucket holds texts that share a key by chance or by boilerplate, and is split by ``MORE_BANDS`` further
   keys of fresh minima; its parts go through the same steps. After ``SPLITS`` splits all strangers count as few.
   A pair at ``LEAST`` stays together in a split with probability 0.986 for each of its common buckets, of which it
   has 6.6 on average.
3. The shingles of all shapes in buckets are made again from the text, once, and likeness is exact.

Defined cases: texts without words are copies of each other; null texts are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.llm.common import quoted
from flowscope.llm.op8_simhash import BUCKET, SEED, component_labels
from flowscope.session import scratch_path

SHINGLE = 5
LEAST = 80
BANDS, ROWS = 16, 4
MORE_BANDS, MORE_ROWS = 6, 3
SPLITS = 4
STEP = 1 << 14
U = np.uint64


SHAPES = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("shape", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])
SETS = pa.schema([("shape", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes."""
    words = text.lower().split()
    runs = zip(*(words[j:] for j in range(size)), strict=False) if len(words) >= size else [words] if words else []
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, runs)), U))


def digest(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), seed=SEED)


@cache
def mappings(split: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of the random mappings of a split; 0 are those of the first buckets."""
    drawn = np.random.default_rng(SEED + split).integers(0, 1 << 64, (2, count, 1), U)
    return drawn[0] | U(1), drawn[1]


def band_keys(own: np.ndarray, split: int = 0) -> list[int]:
    """A key per band; none of a text without words."""
    if not len(own):
        return []
    bands, rows = (MORE_BANDS, MORE_ROWS) if split else (BANDS, ROWS)
    factors, shifts = mappings(split, bands * rows)
    least = np.full(bands * rows, np.iinfo(U).max, U)
    for at in range(0, len(own), STEP):
        mapped = (own[at : at + STEP] ^ shifts) * factors
        least = np.minimum(least, (mapped ^ (mapped >> U(32))).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), seed=band) for band, part in enumerate(least.reshape(bands, rows))]


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. A checkpoint would do, but carries what the planner has inferred on to the next
    round, which grows with every round."""
    path = scratch_path(df.sparkSession, "near-copies")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, U).view(np.int64)


def shapes_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n, keys = [], [], []
        for t in batch.column("body"):
            own = shingles(t.as_buffer().to_pybytes(), size)
            found.append(digest(own))
            n.append(len(own))
            keys.append(signed(band_keys(own)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(signed(found)), pa.array(n, pa.int64()), pa.array(keys, SHAPES.field("keys").type)], schema=SHAPES)


def sets_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            sets = [shingles(t.as_buffer().to_pybytes(), size) for t in batch.column(0).slice(at, 64)]
            yield pa.RecordBatch.from_arrays([pa.array(signed([digest(s) for s in sets])), pa.array([s.view(np.int64) for s in sets], SETS.field("shingles").type)], schema=SETS)


MORE = pa.schema([("of", pa.int64()), ("more", pa.list_(pa.int64()))])


def more_keys(batches: Iterator[pa.RecordBatch], split: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [signed(band_keys(own.values.to_numpy().view(U), split)) for own in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("shape"), pa.array(keys, MORE.field("more").type)], schema=MORE)


def sets_for(rows: DataFrame, shapes: DataFrame, met: DataFrame, size: int) -> DataFrame:
    """``shape`` and its ``shingles`` for all that are to be compared; the texts are read again once for that."""
    own = shapes.join(met.distinct(), "shape", "left_semi").select("row")
    bodies = rows.select("row", "body").join(own, "row", "left_semi").select("body")
    return settled(bodies.mapInArrow(partial(sets_of, size=size), "shape long, shingles array<long>"))


def alike(sets: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """Those of the pairs (``a``, ``n_a``, ``b``, ``n_b``) that are near copies, as ``a`` < ``b``; None if no pair can be."""
    likely = pairs.where(f"a <> b AND 100 * least(n_a, n_b) >= {LEAST} * greatest(n_a, n_b)")
    likely = settled(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n_a") + F.col("n_b")).alias("n")).distinct())
    if not likely.limit(1).count():
        return None
    own = likely.join(sets.select(F.col("shape").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = own.join(sets.select(F.col("shape").alias("b"), F.col("shingles").alias("of_b")), "b")
    same = both.select("a", "b", "n", F.size(F.array_intersect("of_a", "of_b")).alias("same"))
    return settled(same.where(f"100 * same >= {LEAST} * (n - same)").select("a", "b"))


def sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("key", F.col("shape").alias(side), F.col("n").alias(f"n_{side}"))


def in_buckets(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets (``key``, ``members``) of two to ``BUCKET`` shapes, and the members of larger ones, each with the hub (``b``, ``n_b``)."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("shape"), "shape"))
    some = keyed.withColumn("place", place).where(F.col("place") <= BUCKET + 1).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "shape", "n"))).alias("members"))
    buckets = settled(some.where(F.size("members") > 1))
    large = buckets.where(F.size("members") > BUCKET).select("key", F.col("members")[0]["shape"].alias("b"), F.col("members")[0]["n"].alias("n_b"))
    return buckets.where(F.size("members") <= BUCKET), settled(sided(keyed, "a").join(large, "key"))


def pairs_in(buckets: DataFrame) -> DataFrame:
    one = buckets.select("members", F.explode("members").alias("x"))
    both = one.select("x", F.explode(F.filter("members", lambda m: m["shape"] > F.col("x.shape"))).alias("y"))
    return both.select(F.col("x.shape").alias("a"), F.col("x.n").alias("n_a"), F.col("y.shape").alias("b"), F.col("y.n").alias("n_b"))


def links(rows: DataFrame, shapes: DataFrame, size: int) -> DataFrame:
    """Pairs of shapes (``shape``, ``row``, ``n``, ``keys``) that are near copies, as many as connect all that are."""
    keyed, sets, found = shapes.select(F.explode("keys").alias("key"), "shape", "n"), None, []
    none = rows.sparkSession.createDataFrame([], "a long, b long")
    for split in range(SPLITS + 1):
        small, busy = in_buckets(keyed)
        if sets is None:
            met = small.select(F.explode("members.shape").alias("shape")).unionByName(busy.select(F.col("a").alias("shape")))
            sets = sets_for(rows, shapes, met, size)
        found.append(alike(sets, pairs_in(small).unionByName(busy.drop("key"))))
        if not busy.limit(1).count():
            break
        # Whoever has found the hub's component, through this bucket or another, is connected with all of it.
        labels = component_labels(settled(reduce(DataFrame.unionByName, (f for f in found if f is not None), none).distinct()))
        hubs = busy.select("key", "b").distinct().join(labels.select(F.col("node").alias("b"), F.col("label").alias("of_hub")), "b", "left")
        own = busy.join(labels.select(F.col("node").alias("a"), "label"), "a", "left")
        same = own.join(hubs.select("key", "of_hub"), "key").withColumn("known", (F.col("a") == F.col("b")) | F.coalesce(F.col("label") == F.col("of_hub"), F.lit(False)))
        marked = settled(same.select("key", F.col("a").alias("shape"), F.col("n_a").alias("n"), "known"))
        strangers = marked.where("NOT known")
        counts = settled(strangers.groupBy("key").agg(F.count(F.lit(1)).alias("strangers")))
        last = split == SPLITS
        few = strangers.join(counts.where(F.lit(last) | (F.col("strangers") <= BUCKET)), "key", "left_semi")
        found.append(alike(sets, sided(few, "a").join(sided(marked, "b"), "key").drop("key")))
        many = counts.where(~F.lit(last) & (F.col("strangers") > BUCKET))
        if not many.limit(1).count():
            break
        apart = settled(marked.join(many, "key", "left_semi").select("key", "shape", "n"))
        wanted = sets.join(apart.select("shape").distinct(), "shape", "left_semi")
        more = wanted.mapInArrow(partial(more_keys, split=split + 1), "of long, more array<long>")
        parts = apart.join(more, F.col("shape") == F.col("of")).select("key", "shape", "n", F.posexplode("more").alias("band", "more"))
        keyed = settled(parts.select(F.xxhash64("key", "band", "more").alias("key"), "shape", "n"))
    return settled(reduce(DataFrame.unionByName, (f for f in found if f is not None), none).distinct())


def labelled(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Every row's ``shape`` (with ``row`` and ``id``), and ``node`` and ``label`` of the shapes that have links."""
    found = settled(rows.mapInArrow(partial(shapes_of, size=size), "row long, id long, shape long, n long, keys array<long>"))
    # Copies have equal keys, so any row may stand for a shape.
    first = found.groupBy("shape").agg(F.min("row").alias("row"))
    shapes = settled(found.join(first.select("row"), "row", "left_semi"))
    return found.select("row", "id", "shape"), component_labels(links(rows, shapes, size))


def components(rows: DataFrame, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``row`` and ``label`` of every row; rows of one label are near copies of each other or linked by such.

    ``rows`` has a distinct ``row`` (long) that comes out the same whenever it is computed.
    """
    bodies = rows.select("row", F.lit(None).cast("long").alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    found, labels = labelled(bodies, size)
    return found.join(labels, F.col("shape") == labels["node"], "left").select("row", F.coalesce("label", "shape").alias("label"))


def first_rows(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The ``row`` of each component that stays: the smallest ``id``, of its rows the first; no id comes last.

    ``rows`` has ``row`` (as above), ``id`` and ``body``. Copies are folded before anything is joined by component.
    """
    found, labels = labelled(rows.select("row", F.col("id").cast("long").alias("id"), F.coalesce("body", F.lit("")).alias("body")), size)
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "row")
    copies = settled(found.groupBy("shape").agg(F.min(place).alias("place")))
    joined = copies.join(labels, F.col("shape") == labels["node"], "left")
    return settled(joined.groupBy(F.coalesce("label", "shape").alias("label")).agg(F.min("place").alias("place")).select("place.row"))
