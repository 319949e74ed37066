"""I-Match document fingerprints, in DataFrame functions only.

The lexicon holds the terms whose inverse document frequency lies in a band: those in at least ``LEAST`` and at most
``MOST`` of all documents. There can be no more of them than distinct terms per document / ``LEAST``, whatever the size
of the corpus. A text that more than ``COPIED`` of all rows hold counts as one document there (there are at most
1 / ``COPIED`` such texts), so that copies push no term out of the band.

Randomised subsets come in levels: a level cuts the terms at random into ``classes`` parts and uses ``used`` of them, so
that a level of small parts tells long texts apart and one of large parts short ones. The first levels are made from
the lexicon's terms, the last one from all terms, for texts that have few in the lexicon. A fingerprint hashes, for each
subset, the sorted distinct terms of the document that lie in it; a subset without any is empty.

Likeness of two fingerprints: per level, the share of equal hashes among the subsets not empty in both. The best level of
the lexicon counts, of those with at least ``FEW`` such subsets; if there is none, the level of all terms, and if that
has fewer too, the coarsest that has any. So both texts are compared by the same kind of terms. Terms are told apart by
64-bit hashes.

Defined cases: a null or empty text has no terms; two fingerprints without any subset are alike (1). Documents form a
ring by distinct id; where rows repeat an id, the next document is its smallest text. A null id stands outside the ring:
its edited text only loses its end, and its likeness to a next document is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowscope.llm.common import keyed_text, table
from flowscope.plans.registry import query
from flowscope.session import cut_lineage

LEAST, MOST = 0.005, 0.2
COPIED = 1e-4
FEW = 4
# (classes, used) of each level of the lexicon's terms, and of the level of all terms.
LEVELS = ((16, 16), (128, 32), (1024, 32))
ALL_TERMS = (64, 32)
SUBSETS = sum(used for _, used in (*LEVELS, ALL_TERMS))


def term_hashes(body: Column) -> Column:
    """Distinct terms of a text: runs of letters and digits, lower-cased, as 64-bit hashes."""
    words = F.array_distinct(F.split(F.lower(body), r"[^\p{L}\p{N}]+"))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def longs(values: list[int]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def lexicon(docs: DataFrame) -> list[int]:
    """Terms in the band; bounded by distinct terms per document / LEAST."""
    named = docs.select("body", F.xxhash64("body").alias("h0"), F.xxhash64(F.lit(1), "body").alias("h1"))
    texts = cut_lineage(named.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("copies")))
    rows = texts.agg(F.sum("copies")).first()[0] or 0
    often = texts.where(F.col("copies") > max(1, COPIED * rows))
    n = rows - (often.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    weighed = named.join(F.broadcast(often), ["h0", "h1"], "left").select(F.explode(term_hashes(F.col("body"))).alias("term"), F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"))
    # Shares of copies add up to whole numbers but for rounding.
    found = weighed.groupBy("term").agg(F.round(F.sum("weight"), 3).alias("df"))
    return sorted(r.term for r in found.where(F.col("df").between(max(2, LEAST * n), MOST * n)).select("term").toLocalIterator())


def signature(body: Column, terms: list[int]) -> Column:
    """SUBSETS hashes of 16 bits, null where a subset is empty."""
    found = F.array(F.array_sort(term_hashes(body)))
    both = F.transform(found, lambda own: F.struct(own.alias("own"), F.filter(own, lambda h: h.isin(terms)).alias("known")))

    def hashed(part: Column) -> Column:
        return F.when(F.size(part) > 0, F.xxhash64(part).bitwiseAND(F.lit(0xFFFF)).cast("int"))

    def level(own: Column, classes: int, used: int, shift: int) -> Column:
        place = lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(classes - 1))
        inside = F.array(own if used == classes else F.filter(own, lambda h: place(h) < used))
        parts = lambda part: F.transform(F.sequence(F.lit(0), F.lit(used - 1)), lambda c: hashed(F.filter(part, lambda h: place(h) == c)))
        return F.transform(inside, parts)[0]

    shifts = [3 + 12 * i for i in range(len(LEVELS) + 1)]
    levels = lambda k: [*(level(k["known"], c, u, s) for (c, u), s in zip(LEVELS, shifts, strict=False)), level(k["own"], *ALL_TERMS, shifts[-1])]
    return F.transform(both, lambda k: F.concat(*levels(k)))[0]


def likeness(a: str, b: str) -> Column:
    """0 to 1; see the module."""
    shares, at = [], 1
    for _, used in (*LEVELS, ALL_TERMS):
        pairs = F.arrays_zip(F.slice(a, at, used).alias("x"), F.slice(b, at, used).alias("y"))
        shown = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
        same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
        share = same / F.when(shown > 0, shown)
        shares.append((share, F.when(shown >= FEW, share)))
        at += used
    best = F.greatest(*(enough for _, enough in shares[:-1]))
    return F.coalesce(best, shares[-1][1], *(share for share, _ in shares), F.lit(1.0)).cast("double")


def as_text(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 4, "0")), F.lit("----"))), "")


def ring(docs: DataFrame) -> DataFrame:
    """``doc``, ``next`` (the next larger id; after the last the first) and ``need``: how much of the next text it takes."""
    ids = docs.where("doc IS NOT NULL").groupBy("doc").agg(F.max(F.floor(F.length("body") / 4)).cast("int").alias("need"))
    dealt = cut_lineage(ids.repartitionByRange("doc").withColumn("part", F.spark_partition_id()))
    # One value per partition of the session.
    firsts = sorted((r.part, r.first) for r in dealt.groupBy("part").agg(F.min("doc").alias("first")).collect())
    parts = longs([p for p, _ in firsts])
    borders = docs.sparkSession.range(1).select(F.explode(F.arrays_zip(parts.alias("part"), longs([f for _, f in firsts[1:] + firsts[:1]]).alias("border"))).alias("b"))
    borders = F.broadcast(borders.select("b.part", "b.border"))
    inside = dealt.withColumn("inner", F.lead("doc").over(Window.partitionBy("part").orderBy("doc")))
    return cut_lineage(inside.join(borders, "part").select("doc", F.coalesce("inner", "border").alias("next"), "need"))


def with_edits(docs: DataFrame, order: DataFrame) -> DataFrame:
    """``edited``: the last quarter of a text replaced by as much of the start of the next document."""
    # Both joins read the one exchange: rows without an id, which neither needs, would tell their plans apart.
    dealt = docs.where("doc IS NOT NULL").repartition("doc")
    heads = dealt.join(order.select(F.col("next").alias("doc"), F.col("doc").alias("before"), "need"), "doc")
    heads = heads.select("before", F.expr("substring(body, 1, need)").alias("head")).groupBy("before").agg(F.min("head").alias("head"))
    both = dealt.join(heads, dealt["doc"] == heads["before"], "left").select("doc", "body", F.coalesce("head", F.lit("")).alias("head"))
    both = both.unionByName(docs.where("doc IS NULL").withColumn("head", F.lit("")))
    edited = F.concat(F.expr("substring(body, 1, length(body) - length(body) div 4)"), F.expr("substring(head, 1, length(body) div 4)"))
    return both.select("doc", F.length("body").cast("long").alias("n_chars"), "body", edited.alias("edited"))


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` and ``signature`` of every row."""
    docs = keyed_text(df, id_col, text_col)
    return docs.select("doc", signature(F.col("body"), lexicon(docs)).alias("signature"))


def fingerprints_and_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to each other and to the next document's."""
    docs = keyed_text(df, id_col, text_col)
    terms, order = lexicon(docs), ring(docs)
    edits = with_edits(docs, order)
    own = edits.select(
        "doc",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        signature(F.col("body"), terms).alias("signature"),
        signature(F.col("edited"), terms).alias("edited_signature"),
    )
    own = cut_lineage(own)
    following = own.select(F.col("doc").alias("next"), F.col("signature").alias("next_signature")).join(order.select("next", F.col("doc").alias("before")), "next")
    following = following.groupBy("before").agg(F.min("next_signature").alias("next_signature"))
    out = own.join(following, own["doc"] == following["before"], "left")
    return out.select(
        "doc",
        "n_chars",
        "edited_sha256",
        as_text("signature").alias("fingerprint"),
        as_text("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        F.when(F.col("next_signature").isNull(), 0.0).otherwise(likeness("signature", "next_signature")).alias("near_next"),
    )


@query("op1_imatch")
def op1_imatch(spark, sf_dir):
    return fingerprints_and_edits(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")
