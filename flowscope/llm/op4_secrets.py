"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings stand on their own: ``assign`` (a named secret of 12 or more characters), ``access`` (an access key id) and
``hex`` (16 or more hexadecimal digits). Weak candidates are reported only where a complementary part lies within
``SCOPE`` code points, found by interval semi-joins that emit no pairs:

* ``ident``, a named user, client or key id: with a secret (any but another ident or an access key id) in scope;
* ``short``, a named secret of 4 to 11 characters, and ``blob``, 20 or more characters of mixed kinds: with an identifier
  (``access`` or ``ident``) or an ``endpoint`` in scope;
* ``endpoint``, a URL: with an identifier and a secret in scope.

A weak candidate that overlaps a base finding is dropped. Positions are code points; a span is a whole match. Matches are
cut out by pattern, and a running sum over the pieces between them gives their places.

Defined cases: a null or empty text has no findings; every row of a repeated id, or of a null one, gets its own result;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowscope.llm.common import quoted, table
from flowscope.plans.registry import query
from flowscope.session import cut_lineage

SCOPE = 200
# Patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST, SHORT_LEAST = 12, 18, 4
# Patterns of weak candidates.
IDENT = r"""((?i:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
BLOB = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "ident", "short", "blob", "endpoint")
NUMBER = {name: i for i, name in enumerate(KINDS)}
BASE = tuple(NUMBER[k] for k in ("assign", "access", "hex"))
IDENTIFIERS = tuple(NUMBER[k] for k in ("access", "ident"))
SECRETS = tuple(NUMBER[k] for k in ("assign", "hex", "short", "blob"))
PIECE = "array<struct<family:int,at:int,gap:int,size:int,kind:int>>"


def pieces(body: Column, family: int, pattern: str, kind) -> Column:
    """All matches of a pattern: the piece before each, its size, and the kind that ``kind(match, value)`` gives it."""
    valued = pattern in (ASSIGN, IDENT)
    gaps = F.split(body, pattern, -1)
    whole = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(body, F.lit(pattern), F.lit(2 if valued else 0))
    # The last piece has no match after it and falls away in the zip with the matches.
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), values.alias("value")),
        lambda m, i: F.struct(F.lit(family).alias("family"), i.alias("at"), F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("size"), kind(m["whole"], m["value"]).cast("int").alias("kind")),
    )
    return F.when(body.rlike(pattern), rows).otherwise(F.array()).cast(PIECE)


def named_secret(whole: Column, value: Column) -> Column:
    n = F.length(value)
    return F.when(n >= ASSIGN_LEAST, NUMBER["assign"]).when(n >= SHORT_LEAST, NUMBER["short"])


def mixed_blob(whole: Column, value: Column) -> Column:
    return F.when(whole.rlike("[0-9]") & whole.rlike("[a-z]") & whole.rlike("[A-Z]"), NUMBER["blob"])


FAMILIES = (
    (ASSIGN, named_secret),
    (ACCESS, lambda whole, value: F.when(F.length(whole) >= ACCESS_LEAST, NUMBER["access"])),
    (HEX, lambda whole, value: F.lit(NUMBER["hex"])),
    (IDENT, lambda whole, value: F.lit(NUMBER["ident"])),
    (BLOB, mixed_blob),
    (ENDPOINT, lambda whole, value: F.lit(NUMBER["endpoint"])),
)


def parts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Candidates of all kinds with their places; a row without any keeps one line of nulls."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).cast("long").alias("doc"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    found = F.concat(*(pieces(F.col("body"), i, pattern, kind) for i, (pattern, kind) in enumerate(FAMILIES)))
    laid = rows.select("row", "doc", F.explode_outer(found).alias("p")).select("row", "doc", "p.*")
    before = Window.partitionBy("row", "family").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(before).cast("int")
    return laid.select("row", "doc", "kind", (end - F.col("size")).alias("start"), end.alias("end"))


def over_scopes(parts: DataFrame, margin: int) -> DataFrame:
    """A row for each stretch of SCOPE code points that the part, widened by ``margin``, touches."""
    first, last = F.floor((F.col("start") - margin) / SCOPE), F.floor((F.col("end") - 1 + margin) / SCOPE)
    return parts.withColumn("scope", F.explode(F.sequence(first, last)))


def with_neighbour(candidates: DataFrame, parts: DataFrame, kinds: tuple[int, ...], reach: int, how: str = "left_semi") -> DataFrame:
    """Candidates with (or, by ``left_anti``, without) a part of ``kinds`` fewer than ``reach`` code points away."""
    other = over_scopes(parts.where(F.col("kind").isin(*kinds)), 0).select(*(F.col(c).alias(f"o_{c}") for c in ("row", "scope", "start", "end")))
    mine = over_scopes(candidates, reach)
    near = (F.col("o_start") < F.col("end") + reach) & (F.col("o_end") > F.col("start") - reach)
    met = mine.join(other, (F.col("row") == F.col("o_row")) & (F.col("scope") == F.col("o_scope")) & near, "left_semi").drop("scope").distinct()
    return met if how == "left_semi" else candidates.join(met, ["row", "doc", "kind", "start", "end"], "left_anti")


def linked(parts: DataFrame) -> DataFrame:
    """Weak candidates whose complementary parts co-occur."""
    weak = parts.where(F.col("kind").isNotNull() & ~F.col("kind").isin(*BASE))
    free = cut_lineage(with_neighbour(weak.where("row IS NOT NULL").select("row", F.coalesce("doc", F.lit(0)).alias("doc"), "kind", "start", "end"), parts, BASE, 0, "left_anti"))
    around = cut_lineage(parts.where(F.col("kind").isin(*BASE)).select("row", F.coalesce("doc", F.lit(0)).alias("doc"), "kind", "start", "end").unionByName(free))
    of = lambda *names: free.where(F.col("kind").isin(*(NUMBER[n] for n in names)))
    idents = with_neighbour(of("ident"), around, SECRETS, SCOPE)
    secrets = with_neighbour(of("short", "blob"), around, (*IDENTIFIERS, NUMBER["endpoint"]), SCOPE)
    endpoints = with_neighbour(with_neighbour(of("endpoint"), around, IDENTIFIERS, SCOPE), around, SECRETS, SCOPE)
    return idents.unionByName(secrets).unionByName(endpoints).select("row", F.lit(None).cast("long").alias("doc"), "kind", "start", "end")


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc`` and its findings, ``base`` and ``all``, as sorted arrays of (start, kind, end)."""
    parts = cut_lineage(parts_of(df, id_col, text_col))
    spans = parts.withColumn("kind", F.when(F.col("kind").isin(*BASE), F.col("kind"))).unionByName(linked(parts))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    found = spans.groupBy("row").agg(F.max("doc").alias("doc"), F.array_sort(F.collect_list(span)).alias("all"))
    return found.select("doc", F.filter("all", lambda s: s["kind"] <= max(BASE)).alias("base"), "all")


def as_text(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op4_secrets")
def op4_secrets(spark, sf_dir):
    out = secrets(table(spark, sf_dir, "documents"))
    n = lambda name: F.size(F.filter("base", lambda s: s["kind"] == NUMBER[name])).cast("long").alias(f"n_{name}")
    return out.select(F.col("doc").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("all").alias("spans"))
