"""Merkle manifest of a dataset by slot pivots: a subroot per group of rows, one root, and a proof for every row.

A leaf is the SHA-256 of a row's fields; every ``fanout`` consecutive nodes of a group (ascending id) become the hash of
their digests until one is left, the subroot; the subroots, ordered by group, become the root in the same way.

1. Leaves are hashed in one scan, range-partitioned by (group, id) and numbered by counts per (partition, group), so that
   neither a large group nor a repeated id is sorted in one task.
2. Upward, conditional aggregates spread the nodes under one ancestor into ``fanout ** depth`` slot columns. Joined slot
   columns hash to the columns of the next level, ``depth`` levels a shuffle. Digests only; texts are not read again.
3. Downward, each ancestor hands its proof to its nodes: at every level the slot columns of the run without the own one
   are the siblings, those left of it and those right of it. A parent joins its own few children only.
4. The root is folded again from the leaf that is claimed and the siblings on both sides.

Defined cases: a null field counts as ``-``; a null id sorts first and a null group is a group, the first one; rows that
repeat an id are ordered by their digests; equal rows have proofs of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.llm.common import quoted, table
from flowscope.operators.index import with_row_index
from flowscope.plans.registry import query
from flowscope.session import cut_lineage

FANOUT = 2
# Levels that one pivot climbs.
DEPTH = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7
PATH = "array<struct<before:string,after:string>>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each with its length in bytes; ``-`` stands for null."""
    texts = [f.cast("string") for f in fields]
    return sha(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def levels_above(n: Column, fanout: int) -> Column:
    """Levels until one of n nodes is left."""
    powers = [fanout**i for i in range(64) if fanout**i < 1 << 62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < n))


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (``grp``, ``id``, ``leaf`` and more) with ``tree``, ``pos`` and ``left`` (levels above), and the groups' trees."""
    order = ["grp", "id", "leaf", "tie"]
    tied = cut_lineage(leaves).withColumn("tie", F.monotonically_increasing_id())
    placed = cut_lineage(tied.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = cut_lineage(placed.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")))
    trees = cut_lineage(with_row_index(runs.groupBy("grp").agg(F.sum("n").alias("size")), ["grp"], "tree", unique=True))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("part", F.col("grp").alias("of"), (before - F.col("first")).alias("shift"))
    starts = starts.join(trees, F.col("of").eqNullSafe(F.col("grp"))).drop("grp").withColumnRenamed("part", "in_part")
    joined = placed.join(starts, (F.col("part") == F.col("in_part")) & F.col("grp").eqNullSafe(F.col("of")))
    out = joined.withColumn("pos", F.col("at") + F.col("shift"))
    return out.drop("tie", "at", "part", "in_part", "of", "shift"), trees


def node(level: int, i: int) -> str:
    return f"node_{level}_{i}"


def pivoted(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """One row per ancestor: its nodes in slot columns, and the digests of all levels up to its own.

    ``nodes`` has ``tree``, ``pos``, ``left`` and ``item``, a struct whose first field is the digest.
    """
    span = fanout**depth
    slot = F.pmod("pos", F.lit(span))
    slots = [F.max(F.when(slot == i, F.col("item"))).alias(f"item_{i}") for i in range(span)]
    rows = nodes.groupBy("tree", "left", F.floor(F.col("pos") / span).cast("long").alias("at")).agg(*slots)
    rows = rows.select("*", *(F.col(f"item_{i}.digest").alias(node(0, i)) for i in range(span)))
    for level in range(1, depth + 1):
        made = []
        for i in range(span // fanout**level):
            children = [F.col(node(level - 1, i * fanout + c)) for c in range(fanout)]
            made.append(F.when(children[0].isNull(), None).when(F.col("left") >= level, sha(*children)).otherwise(children[0]).alias(node(level, i)))
        rows = rows.select("*", *made)
    return cut_lineage(rows)


def climbed(nodes: DataFrame, fanout: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Pivots from the leaves to the tops, and the top of every tree (``tree``, ``digest``)."""
    pivots = []
    while True:
        pivots.append(pivoted(nodes, fanout, depth))
        left = F.greatest(F.col("left") - depth, F.lit(0))
        nodes = pivots[-1].select("tree", F.col("at").alias("pos"), left.alias("left"), F.struct(F.col(node(depth, 0)).alias("digest")).alias("item"))
        if not pivots[-1].where(F.col("left") > depth).limit(1).count():
            return pivots, nodes.select("tree", "item.digest")


def siblings(i: int, fanout: int, depth: int) -> Column:
    """Per level the digests of the run before and after the own one, for slot ``i``."""
    levels = []
    for level in range(depth):
        own = i // fanout**level
        first = own - own % fanout
        before = [F.col(node(level, s)) for s in range(first, own)]
        after = [F.col(node(level, s)) for s in range(own + 1, first + fanout)]
        levels.append(F.struct(F.concat_ws("", *before).alias("before"), F.concat_ws("", *after).alias("after")))
    return F.slice(F.array(*levels), F.lit(1), F.least(F.col("left"), F.lit(depth)))


def descended(pivots: list[DataFrame], tops: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The leaves' items with ``path``, the siblings from the leaf up. ``tops``: ``tree``, ``path`` above its top, and more."""
    span = fanout**depth
    rows = tops.withColumn("at", F.lit(0).cast("long"))
    carried = [c for c in tops.columns if c not in ("tree", "path")]
    for pivot in reversed(pivots):
        joined = pivot.join(rows, ["tree", "at"])
        slots = [F.struct(F.lit(i).alias("slot"), F.col(f"item_{i}").alias("item"), F.concat(siblings(i, fanout, depth), F.col("path")).alias("path")) for i in range(span)]
        slots = F.filter(F.array(*slots), lambda s: s["item"].isNotNull())
        opened = joined.select("tree", "at", *carried, F.explode(slots).alias("s"))
        rows = opened.select("tree", (F.col("at") * span + F.col("s.slot")).alias("at"), *carried, "s.item", "s.path")
        if pivot is not pivots[0]:
            rows = rows.drop("item")
    return rows


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, run: sha(run["before"], digest, run["after"]))


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS, fanout: int = FANOUT, depth: int = DEPTH, claimed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: ``id``, ``leaf``, ``subroot``, ``root``, ``path``, ``folded_root`` and ``verified``.

    ``path`` has the siblings from the leaf to the root. ``claimed`` replaces fields by other columns before the root is
    folded and compared, as a copy of the data that has to prove itself would.
    """
    now = [(claimed or {}).get(f, quoted(f)) for f in fields]
    leaves = df.select(quoted(group_col).alias("grp"), quoted(id_col).alias("id"), leaf_of([quoted(f) for f in fields]).alias("leaf"), leaf_of(now).alias("claim"))
    rows, trees = numbered(leaves)
    nodes = rows.select("tree", "pos", levels_above(F.col("size"), fanout).alias("left"), F.struct(F.col("leaf").alias("digest"), "id", "claim").alias("item"))
    pivots, subroots = climbed(nodes, fanout, depth)
    n = F.lit(trees.count())
    groups = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), levels_above(n, fanout).alias("left"), F.struct("digest", F.col("tree").alias("of")).alias("item"))
    top_pivots, root = climbed(groups, fanout, depth)
    start = root.select("tree", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = descended(top_pivots, start, fanout, depth).select(F.col("item.of").alias("tree"), F.col("item.digest").alias("subroot"), "root", "path")
    proved = descended(pivots, tops, fanout, depth)
    out = proved.select("item.id", F.col("item.digest").alias("leaf"), "subroot", "root", "path", folded(F.col("item.claim"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""
FIELD_SQL = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"


def leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(FIELD_SQL.format(f) for f in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {leaf_sql("n_chars")} AS leaf,
         CASE WHEN {CRC_SQL.format("doc_id::VARCHAR")} % {TAMPERED} = 0 THEN {leaf_sql("(n_chars + 1)")} ELSE {leaf_sql("n_chars")} END AS claim
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes(level, tree, pos, n, digest) AS (
  SELECT 0, tree, pos, n, leaf FROM placed
  UNION ALL
  SELECT level + 1, tree, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 2, n),
tops(level, pos, n, digest) AS (
  SELECT 0, tree, count(*) OVER (), digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT p.tree, p.pos, 0 AS part, o.level, CASE WHEN o.pos % 2 = 1 THEN coalesce(s.digest, '') || '|' ELSE '|' || coalesce(s.digest, '') END AS step
  FROM placed p JOIN nodes o ON o.tree = p.tree AND o.pos = p.pos >> o.level AND o.n > 1
  LEFT JOIN nodes s ON s.tree = o.tree AND s.level = o.level AND s.pos = xor(o.pos, 1)
  UNION ALL
  SELECT p.tree, p.pos, 1, o.level, CASE WHEN o.pos % 2 = 1 THEN coalesce(s.digest, '') || '|' ELSE '|' || coalesce(s.digest, '') END
  FROM placed p JOIN tops o ON o.pos = p.tree >> o.level AND o.n > 1
  LEFT JOIN tops s ON s.level = o.level AND s.pos = xor(o.pos, 1)),
paths AS (SELECT tree, pos, list(step ORDER BY part, level) AS path FROM steps GROUP BY tree, pos),
folded AS (
  SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(p.claim, coalesce(path, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM placed p LEFT JOIN paths USING (tree, pos) JOIN nodes r ON r.tree = p.tree AND r.n = 1 JOIN tops t ON t.n = 1)
SELECT *, folded_root = root AS verified FROM folded
"""


@query("op11_merkle", SQL)
def op11_merkle(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    claimed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    out = manifest(table(spark, sf_dir, "documents"), claimed=claimed)
    proof = F.transform("path", lambda run: F.concat(run["before"], run["after"]))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join(proof, ""), 256).alias("proof_sha256"), "folded_root", "verified")
