"""Queries over sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.operators import sample as P
from flowscope.plans import bindings as B
from flowscope.plans.registry import query

# An arithmetic hash both engines can compute.
MODULUS = 10_007


def arithmetic_key(idx: str, seed: int = 42):
    return F.pmod(F.col(idx) * 7919 + F.lit(seed), F.lit(MODULUS))


def draw():
    return arithmetic_key("event_id") / float(MODULUS)


DRAW_SQL = f"((event_id * 7919 + 42) % {MODULUS}) / {MODULUS}.0"


@query(
    "stratified_fraction",
    f"""WITH {B.FLOWS_SQL} SELECT "Family" AS family, CAST(round(count(*) * 0.3) AS BIGINT) AS n FROM flows GROUP BY 1""",
)
def stratified_fraction(spark, sf_dir):
    """Rows kept per label at 30 %."""
    df = B.flows(spark, sf_dir)
    kept = P.stratified_sample(df, "Family", 0.3, B.FLOW_IDS)
    return kept.groupBy(F.col("Family").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stratified_repeated_rows",
    """WITH c AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
       r AS (SELECT *, CAST(l_quantity AS BIGINT) * 7919 % 10007 AS k, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM c),
       u AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY k, l_quantity, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING) AS upto FROM r)
       SELECT l_returnflag, l_linestatus, l_quantity, CAST(greatest(0, least(n, ceil(round(total * 0.25, 6)) - (upto - n))) AS BIGINT) AS n_test,
         CAST(n AS BIGINT) AS n FROM u""",
)
def stratified_repeated_rows(spark, sf_dir):
    """A split of rows that repeat thousands of times: the quota holds within the copies."""
    df = B.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    key = F.pmod(F.col("l_quantity").cast("bigint") * 7919, F.lit(MODULUS))
    flagged = P.stratified_split(df, "l_returnflag", 0.25, ["l_quantity"], key, MODULUS)
    return flagged.groupBy(*df.columns).agg(F.count_if("is_test").alias("n_test"), F.count(F.lit(1)).alias("n"))


@query("bagged_fraction")
def bagged_fraction(spark, sf_dir):
    df = B.flows(spark, sf_dir)
    return P.sampling_ratio(P.bagged_sample(df, "Label", 0.3, 4, B.FLOW_IDS), df)


@query(
    "stratified_size",
    f"""WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type
           ORDER BY (event_id * 7919 + 42) % {MODULUS}, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n,
           count(*) OVER () AS total FROM events)
        SELECT event_id, event_type, value FROM r WHERE k <= round(800.0 * n / total)""",
)
def stratified_size(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return P.stratified_size(df, "event_type", 800, ["event_id"], arithmetic_key("event_id"), MODULUS)


@query(
    "random_fraction",
    f"SELECT event_type, count(*) AS n FROM events WHERE {DRAW_SQL} < 0.1 GROUP BY 1",
)
def random_fraction(spark, sf_dir):
    df = B.table(spark, sf_dir, "events")
    return P.simple_sample(df, 0.1, ["event_id"], draw=draw()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stratified_split",
    f"""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
           ORDER BY (event_id * 7919 + 42) % {MODULUS}, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, k <= ceil(round(n * 0.25, 6)) AS is_test, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
        FROM r GROUP BY 1, 2""",
)
def stratified_split(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", "event_type")
    flagged = P.stratified_split(df, "event_type", 0.25, ["event_id"], arithmetic_key("event_id"), MODULUS)
    return flagged.groupBy("event_type", "is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "plain_split",
    f"SELECT {DRAW_SQL} < 0.2 AS is_test, count(*) AS n FROM events GROUP BY 1",
)
def plain_split(spark, sf_dir):
    df = P.plain_split(B.table(spark, sf_dir, "events"), 0.2, ["event_id"], draw=draw())
    return df.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@query(
    "shuffled_folds",
    f"SELECT CAST((event_id * 7919 + 42) % {MODULUS} % 5 AS INTEGER) AS fold, count(*) AS n FROM events GROUP BY 1",
)
def shuffled_folds(spark, sf_dir):
    df = P.fold_ids(B.table(spark, sf_dir, "events"), 5, ["event_id"], key=arithmetic_key("event_id"))
    return df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "random_mask",
    f"""SELECT count(*) AS n_original, count(*) FILTER ({DRAW_SQL} < 0.8) AS n_sampled,
        count(*) FILTER ({DRAW_SQL} < 0.8) * 100.0 / count(*) AS ratio_pct FROM events""",
)
def random_mask(spark, sf_dir):
    df = B.table(spark, sf_dir, "events")
    return P.sampling_ratio(P.random_mask(df, 0.8, ["event_id"], draw=draw()), df)


@query("seed_rows")
def seed_rows(spark, sf_dir):
    """Three distinct rows for each of four candidates."""
    df = B.table(spark, sf_dir, "events").select("event_id", "value")
    return P.draw_seeds(df, 3, ["event_id"], 4)


@query(
    "time_split",
    """WITH r AS (SELECT event_type, event_id // 1000 AS slice, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY event_type, event_id // 1000) AS share
           FROM events WINDOW w AS (PARTITION BY event_type, event_id // 1000 ORDER BY event_id))
       SELECT event_type, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.85 THEN 'val' ELSE 'test' END AS part, count(*) AS n
       FROM r GROUP BY 1, 2""",
)
def time_split(spark, sf_dir):
    df = P.time_split(B.table(spark, sf_dir, "events"), "event_type", "event_id", (0.7, 0.85), 1000)
    return df.groupBy("event_type", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "working_sample",
    f"""SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY (event_id * 7919 + 42) % {MODULUS}, event_id) AS k FROM events)
        WHERE k <= 2000""",
)
def working_sample(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", "value")
    return P.working_sample(df, 2000, ["event_id"], key=arithmetic_key("event_id"), key_range=MODULUS)
