"""Exact top-k search by inner product with a three-phase uniform threshold over score lists.

The components are cut into ``LISTS`` parts. A query's score list of a part holds the inner products with all vectors over
that part; the score is the sum over the lists. A list lies on many nodes, one per stripe of the vectors; queries visit
them in blocks, so a task holds one stripe of one part and a block of queries, and scores exist in the task only.

1. Every node names the best ``GATHERED`` entries of its list for each query. The exact scores of the best of those give
   a floor: the k-th of them is no better than the k-th of all.
2. A score of at least the floor has a part of at least floor / ``LISTS``. That cutoff goes to all nodes with the query,
   and each returns the entries that reach it. What they add up to raises the floor once more, and objects that cannot
   reach it with all their missing parts at the cutoff are settled.
3. The missing parts of the objects left are looked up in the nodes that hold them, which makes their scores exact.

Equal vectors have equal scores. They are one object from the start, which keeps the smallest ids, as many as a result
can hold; rows are told apart again at the end, where a query's own row leaves its list. No list, result or set of
queries passes through the driver; the ranking of entries is cut to k in the map tasks already.

Defined cases: a vector that is null or holds null or non-finite components takes no part; shorter vectors end in zeros;
rows that repeat an id are rows of their own; a null id is no query and comes last among equals; an empty table, or no
other row, gives no result. Scores are exact while the sums stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.llm.common import quoted, table
from flowscope.plans.registry import query
from flowscope.session import cut_lineage

TOP = 5
EVERY = 50
SCALE = 256
LISTS = 2
GATHERED = 64
# Vectors in a stripe, and scores that a task holds at a time.
STRIPE = 1 << 16
BLOCK = 1 << 22
SALTS = 16
# What comes to a node, in this order: its vectors, then the queries, each with its lookups.
VECTOR, ASK, LOOKUP = 0, 1, 2
NODE = "node long, kind int, q long, c long, part array<double>, floor long"
ENTRY = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("list", pa.int32()), ("score", pa.int64())])


def objects(df: DataFrame, id_col: str, vector_col: str, scale: int, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (``c``, ``x``, the smallest ids, ``asks``), and the rows that ask (``id``, ``x``)."""
    vector = quoted(vector_col)
    finite = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    rows = df.where(vector.isNotNull() & finite).select(quoted(id_col).cast("long").alias("id"), F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("x"))
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.select("id", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("x"))).alias("x"))
    asking = rows.where(F.col("id") % every == 0)
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.col("id").asc_nulls_last()))
    kept = rows.withColumn("place", place).where(F.col("place") <= k).groupBy("x").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda e: e["id"]).alias("ids"))
    asked = asking.groupBy("x").agg(F.lit(True).alias("asks"))
    found = kept.join(asked, "x", "left").select(F.monotonically_increasing_id().alias("c"), "x", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    return cut_lineage(found), asking


class Nodes:
    """Where vectors and queries go: one node per stripe of the objects and list."""

    def __init__(self, found: DataFrame):
        n, size = found.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        self.lists = max(1, min(LISTS, size or 1))
        self.stripes = max(-(-n // STRIPE), found.sparkSession.sparkContext.defaultParallelism)
        ends = [(size or 0) * i // self.lists for i in range(self.lists + 1)]
        self.parts = F.array(*(F.struct(F.lit(i).alias("list"), F.slice("x", a + 1, b - a).alias("part")) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))))

    def stripe(self, c) -> F.Column:
        return F.pmod(F.xxhash64(c), F.lit(self.stripes))

    def node(self, stripe, number):
        return stripe * self.lists + number

    def vectors(self, found: DataFrame) -> DataFrame:
        rows = found.select("c", F.explode(self.parts).alias("p"))
        return rows.select(self.node(self.stripe("c"), F.col("p.list")).alias("node"), F.lit(VECTOR).alias("kind"), F.lit(-1).cast("long").alias("q"), "c", "p.part", F.lit(None).cast("long").alias("floor"))

    def asks(self, asking: DataFrame) -> DataFrame:
        """Every query (``c``, ``x``, ``floor``) at every node."""
        rows = asking.select("c", "floor", F.explode(self.parts).alias("p"), ).select("*", F.explode(F.sequence(F.lit(0), F.lit(self.stripes - 1))).alias("stripe"))
        return rows.select(self.node(F.col("stripe"), F.col("p.list")).alias("node"), F.lit(ASK).alias("kind"), F.col("c").alias("q"), F.lit(-1).cast("long").alias("c"), "p.part", "floor")

    def lookups(self, wanted: DataFrame, asking: DataFrame) -> DataFrame:
        """Pairs (``q``, ``c``, ``list``) at the node that holds the part, behind their queries."""
        pairs = wanted.select(self.node(self.stripe("c"), F.col("list")).alias("node"), F.lit(LOOKUP).alias("kind"), "q", "c", F.array().cast("array<double>").alias("part"), F.lit(None).cast("long").alias("floor"), "list")
        own = asking.select(F.col("c").alias("q"), F.explode(self.parts).alias("p")).select("q", F.col("p.list").alias("list"), F.col("p.part").alias("part"))
        visits = pairs.select("node", "q", "list").distinct().join(own, ["q", "list"])
        behind = visits.select("node", F.lit(ASK).alias("kind"), "q", F.lit(-1).cast("long").alias("c"), "part", F.lit(None).cast("long").alias("floor"))
        return behind.unionByName(pairs.drop("list"))

    def run(self, found: DataFrame, visitors: DataFrame, work) -> DataFrame:
        lists = self.lists
        dealt = self.vectors(found).unionByName(visitors).repartition(self.stripes * lists, "node").sortWithinPartitions("node", F.col("kind") > VECTOR, "q", "kind")
        return dealt.select("node", "kind", "q", "c", "part", "floor").mapInArrow(lambda it: at_nodes(it, lists, work), "q long, c long, list int, score long")


def at_nodes(batches: Iterator[pa.RecordBatch], lists: int, work) -> Iterator[pa.RecordBatch]:
    """Keeps the vectors of the node at hand and gives what comes after them to ``work``, in blocks."""
    now, ids, parts, ready = None, [], [], None
    last = None
    for batch in batches:
        node, kind, q, c = (batch.column(i).to_numpy() for i in range(4))
        sizes = pa.compute.list_value_length(batch.column(4)).to_numpy()
        values = batch.column(4).flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        floors = pa.compute.fill_null(batch.column(5), 0).to_numpy()
        free = np.asarray(batch.column(5).is_null())
        edges = np.flatnonzero((node[1:] != node[:-1]) | ((kind[1:] > VECTOR) != (kind[:-1] > VECTOR))) + 1
        for a, b in zip([0, *edges], [*edges, len(node)], strict=True):
            if a == b:
                continue
            if node[a] != now:
                now, ids, parts, ready, last = node[a], [], [], None, None
            width = int(sizes[a])
            rows = values[starts[a] : starts[b - 1] + sizes[b - 1]]
            if kind[a] == VECTOR:
                ids.append(c[a:b].copy())
                parts.append(rows.reshape(b - a, width).copy())
                continue
            if ready is None:
                held = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                order = np.argsort(held)
                ready = held[order], np.concatenate(parts)[order] if parts else np.zeros((0, width))
                ids, parts = [], []
            asks = np.flatnonzero(kind[a:b] == ASK)
            width = int(sizes[a + asks[0]]) if len(asks) else len(last)
            asked = rows.reshape(len(asks), width) if width else np.zeros((len(asks), 0))
            own = asked if last is None else np.concatenate([last[None, :], asked])
            if len(ready[0]):
                yield from work(int(now % lists), *ready, kind[a:b], q[a:b], c[a:b], own, last is not None, floors[a:b], free[a:b])
            if len(asks):
                last = asked[-1].copy()


def entries(number: int, q: np.ndarray, c: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(np.full(len(q), number, np.int32)), pa.array(score.astype(np.int64))], schema=ENTRY)


def blocks(vectors: np.ndarray, asked: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, BLOCK // max(1, len(vectors)))
    for at in range(0, len(asked), step):
        yield at, asked[at : at + step] @ vectors.T


def best_entries(gathered: int):
    """Phase 1: each list's best."""

    def work(number, ids, vectors, kind, q, c, own, carried, floors, free):
        asked = own[1:] if carried else own
        for at, scores in blocks(vectors, asked):
            few = min(gathered, len(ids))
            top = np.argpartition(-scores, few - 1, axis=1)[:, :few]
            yield entries(number, np.repeat(q[at : at + len(scores)], few), ids[top.ravel()], np.take_along_axis(scores, top, 1).ravel())

    return work


def entries_above(lists: int):
    """Phase 2: all entries that reach the cutoff; all where there is none."""

    def work(number, ids, vectors, kind, q, c, own, carried, floors, free):
        asked = own[1:] if carried else own
        for at, scores in blocks(vectors, asked):
            floor = np.where(free[at : at + len(scores)], -np.inf, floors[at : at + len(scores)])
            row, col = np.nonzero(scores * lists >= floor[:, None])
            yield entries(number, q[at + row], ids[col], scores[row, col])

    return work


def looked_up(number, ids, vectors, kind, q, c, own, carried, floors, free):
    """Phase 3, and the exact scores of phase 1."""
    at = np.flatnonzero(kind == LOOKUP)
    which = np.cumsum(kind == ASK)[at] - (0 if carried else 1)
    place = np.searchsorted(ids, c[at])
    for a in range(0, len(at), 1 << 16):
        s = slice(a, a + (1 << 16))
        yield entries(number, q[at[s]], c[at[s]], np.einsum("ij,ij->i", own[which[s]], vectors[place[s]]))


def floor_of(scores: DataFrame, k: int) -> DataFrame:
    """``q`` and the k-th best score, of queries that have so many."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc())
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("q").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("q", "floor")


def searched(found: DataFrame, k: int, gathered: int = GATHERED) -> DataFrame:
    """``q``, ``c``, ``score``: of every object that asks the k best ones, with all that equal the last of them."""
    nodes = Nodes(found)
    lists = nodes.lists
    asking = cut_lineage(found.where("asks").select("c", "x"))
    blank = asking.withColumn("floor", F.lit(None).cast("long"))
    local = nodes.run(found, nodes.asks(blank), best_entries(gathered))
    order = Window.partitionBy("q", "list").orderBy(F.col("score").desc())
    named = cut_lineage(local.withColumn("place", F.row_number().over(order)).where(F.col("place") <= gathered).select("q", "c").distinct())
    each = F.explode(F.array(*(F.lit(i) for i in range(lists)))).alias("list")
    parts = nodes.run(found, nodes.lookups(named.select("q", "c", each), asking), looked_up)
    floors = cut_lineage(floor_of(parts.groupBy("q", "c").agg(F.sum("score").alias("score")), k))
    cut = cut_lineage(asking.join(floors.withColumnRenamed("q", "c"), "c", "left"))
    above = nodes.run(found, nodes.asks(cut), entries_above(lists))
    seen = F.expr("bit_or(shiftleft(1, list))")
    partial = cut_lineage(above.groupBy("q", "c").agg(F.sum("score").alias("score"), F.count(F.lit(1)).cast("int").alias("known"), seen.alias("seen")))
    again = floor_of(partial.where(F.col("known") == lists), k).withColumnRenamed("floor", "raised")
    floors = cut_lineage(floors.join(again, "q", "left").select("q", "floor", F.greatest("floor", "raised").alias("raised")))
    # Whatever a list did not return lies below the cutoff, an integer.
    missing = F.ceil(F.col("floor") / lists) - 1
    hopeful = partial.join(floors, "q", "left").where(F.col("floor").isNull() | (F.col("score") + (lists - F.col("known")) * missing >= F.col("raised"))).select("q", "c", "score", "known", "seen")
    hopeful = cut_lineage(hopeful)
    lacking = hopeful.where(F.col("known") < lists).select("q", "c", each, "seen").where(F.expr("(shiftright(seen, list) & 1) = 0"))
    resolved = nodes.run(found, nodes.lookups(lacking.select("q", "c", "list"), asking), looked_up)
    exact = hopeful.select("q", "c", "score").unionByName(resolved.select("q", "c", "score")).groupBy("q", "c").agg(F.sum("score").alias("score"))
    exact = cut_lineage(exact)
    last = floor_of(exact, k)
    return exact.join(last, "q", "left").where(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).select("q", "c", "score")


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, every: int = EVERY, scale: int = SCALE, gathered: int = GATHERED) -> DataFrame:
    """``query``, ``rank``, ``id`` and ``score``: for each row whose id ``every`` divides the k best other rows."""
    found, asking = objects(df, id_col, vector_col, scale, every, k + 1)
    hits = cut_lineage(searched(found, k + 1, gathered).withColumn("salt", F.pmod(F.xxhash64("q"), F.lit(SALTS))))
    names = hits.select("c", "salt").distinct().join(found.select("c", "ids"), "c")
    named = hits.join(names, ["c", "salt"]).withColumn("first", F.col("ids")[0])
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last(), "c")
    named = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    entry = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.isNull().alias("nameless"), i.alias("id"), F.col("c").alias("c")))
    best = named.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(entry))), 1, k + 1).alias("best"))
    # Many rows may ask with one vector; their joins are dealt out by salt.
    results = best.join(found.select(F.col("c").alias("q"), "x"), "q").withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
    rows = asking.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(results, ["x", "salt"])
    own = F.array_position(F.transform("best", lambda e: (e["c"] == F.col("q")) & F.coalesce(e["id"] == F.col("id"), F.lit(False))), True)
    others = F.slice(F.filter("best", lambda e, i: i + 1 != own), 1, k)
    out = rows.select(F.col("id").alias("query"), F.posexplode(others).alias("rank", "e"))
    return out.select("query", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("id"), (-F.col("e.less")).alias("score"))


SQL = f"""
WITH placed AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM placed q JOIN placed c ON q.vec_id % {EVERY} = 0 AND q.r <> c.r)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM scored) WHERE rank <= {TOP}
"""


@query("op13_topk", SQL)
def op13_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings")).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
