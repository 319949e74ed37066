"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.operators import fit as K
from flowscope.operators import report as R
from flowscope.operators import stats as Q
from flowscope.operators import supervised as M
from flowscope.plans import bindings as B
from flowscope.plans.q_report import rounded
from flowscope.plans.registry import query
from flowscope.session import scratch_path
from flowscope.streaming import runs as S
from flowscope.streaming.batches import cluster_stream
from flowscope.streaming.event_time import event_time_entropy
from flowscope.streaming.sliding import batch_sliding_entropy, stream_sliding_entropy

WINDOW = 16


# Micro-batches that the events come in, each of as many files as the session has shuffle partitions.
BATCHES = 3


def event_stream(spark, sf_dir):
    """The events as a stream of ``BATCHES`` micro-batches by id, which is time order; ids may have gaps or be missing."""
    events, files = B.table(spark, sf_dir, "events"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "events")
    ends = [e for e in Q.exact_quantiles(events, ["event_id"], [i / BATCHES for i in range(1, BATCHES)])["event_id"] if e is not None]
    batch = sum((F.coalesce(F.col("event_id") > e, F.lit(True)).cast("int") for e in ends), F.lit(0))
    for i in range(len(ends) + 1):
        events.filter(batch == i).repartition(files).write.mode("append").parquet(folder)
    assert spark.read.schema(events.schema).parquet(folder).count() == events.count()
    stream = S.read_stream(spark, folder, events.schema, "*.parquet", files)
    return stream.withColumn("share", F.least(F.col("value") / 500, F.lit(1.0)))


def user_entropies(spark, sf_dir):
    stream = stream_sliding_entropy(
        event_stream(spark, sf_dir), "user_id", "share", ["ts", "event_id"], ["event_id", "value"], WINDOW
    )
    return S.drain(stream, "entropy")


USER_ENTROPY_SQL = f"""WITH e AS (SELECT user_id, event_id, least(floor(least(value / 500, 1.0) * 50), 49) AS bin,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        r AS (SELECT a.user_id, a.event_id, a.i, b.bin, count(*) AS n FROM e a JOIN e b ON a.user_id = b.user_id AND b.i BETWEEN a.i - {WINDOW - 1} AND a.i GROUP BY ALL)
        SELECT user_id, event_id, CASE WHEN i >= {WINDOW} THEN round(greatest(0.0, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW}), 6) END AS entropy FROM r GROUP BY user_id, event_id, i"""


@query("stream_sliding_entropy", USER_ENTROPY_SQL)
def stream_sliding(spark, sf_dir):
    """Entropy of the last rows of every user, from a stream over all events."""
    out, _ = user_entropies(spark, sf_dir)
    return rounded(out.select("user_id", "event_id", "entropy"), "entropy")


@query("stream_hot_entity_entropy", USER_ENTROPY_SQL)
def stream_hot_entity(spark, sf_dir):
    """The same by micro-batches of chunked windows, which split a hot user over tasks."""
    stream = event_stream(spark, sf_dir)
    out, _ = batch_sliding_entropy(stream, "user_id", "share", ["ts", "event_id"], ["event_id"], WINDOW)
    return rounded(out, "entropy")


JITTERED_SQL = f"""WITH b AS (SELECT (max(epoch_ms(ts)) - min(epoch_ms(ts))) // 10 AS delay, max(epoch_ms(ts)) AS latest FROM events),
        all_rows AS ({USER_ENTROPY_SQL})
        SELECT a.user_id, a.event_id, a.entropy FROM all_rows a JOIN events e ON e.event_id = a.event_id, b WHERE epoch_us(e.ts) <= (b.latest - b.delay) * 1000"""


@query("stream_event_time_entropy", JITTERED_SQL)
def stream_event_time(spark, sf_dir):
    """The same on rows that arrive out of order: each waits for the watermark, a tenth of the whole time behind."""
    events, files = B.table(spark, sf_dir, "events"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    delay = (ends.high - ends.low) // 10
    # A row may come as much later than its neighbours as the watermark allows.
    late = at + F.pmod(F.xxhash64("event_id"), F.lit(max(delay // 2, 1)))
    folder = scratch_path(spark, "jittered")
    for i in range(BATCHES):
        low, high = (ends.low + (ends.high - ends.low) * (i + j) // BATCHES for j in (0, 1))
        part = events.filter((late >= low) & (F.lit(i == BATCHES - 1) | (late < high)))
        part.repartition(files).write.mode("append").parquet(folder)
    stream = S.read_stream(spark, folder, events.schema, "*.parquet", files).withColumn("share", F.least(F.col("value") / 500, F.lit(1.0)))
    out, _ = S.drain(event_time_entropy(stream, "user_id", "share", "ts", ["event_id"], ["event_id"], f"{delay} milliseconds", 10 * delay, WINDOW), "ordered")
    return rounded(out, "entropy")


@query(
    "stream_batch_clusters",
    """WITH e AS (SELECT event_id, least(value / 500, 1.0) AS share, (row_number() OVER (ORDER BY event_id) - 1) // 1024 AS batch FROM events)
       SELECT batch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(avg(share), 6) AS mean_share, count(*) AS labelled FROM e GROUP BY 1""",
)
def stream_batch_clusters(spark, sf_dir):
    """Batches of 1,024 rows whatever the triggers bring, each standardised and clustered by itself, and the rest at the end."""
    stream = event_stream(spark, sf_dir).select("event_id", "share", F.col("user_id").cast("double").alias("user"))
    out, _ = cluster_stream(stream, ["share", "user"], ["event_id"])
    found = out.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.avg("share").alias("mean_share"), F.count_if(F.col("cluster").isin(0, 1)).alias("labelled")
    )
    return rounded(found, "mean_share")


@query("stream_accounting", f"SELECT count(*) AS rows, {BATCHES} AS batches, true AS cost_known, true AS cost_shared FROM events")
def stream_accounting(spark, sf_dir):
    """Rows and batches of the entropy stream, its cost per row, and that cost with the share of clustering."""
    stream = event_stream(spark, sf_dir)
    entropies = stream_sliding_entropy(stream, "user_id", "share", ["ts", "event_id"], ["event_id", "value"], WINDOW)
    _, batches = S.logged(spark, lambda: S.drain(entropies, "entropy"))
    rows = stream.select("event_id", "share", F.col("user_id").cast("double").alias("user"))
    _, clustering = S.logged(spark, lambda: cluster_stream(rows, ["share", "user"], ["event_id"]))
    per_batch = clustering.filter("rows > 0").agg(F.avg("add_batch_ms").alias("ms"), F.avg("rows").alias("n")).first()
    cost = S.amortised_cost(batches, per_batch.ms, per_batch.n)
    counted = batches.filter("rows > 0").agg(F.count(F.lit(1)).cast("int").alias("batches"))
    return cost.select(
        "rows", F.lit(counted.first().batches).alias("batches"), (F.col("ms_per_row") > 0).alias("cost_known"),
        (F.col("amortised_ms") > F.col("ms_per_row")).alias("cost_shared"),
    )


@query("stream_two_stage_verdict")
def stream_two_stage_verdict(spark, sf_dir):
    """Entropy, then cluster, then purity route, then a classifier for the mixed rest, on a stream."""
    known, _ = user_entropies(spark, sf_dir)
    labels = B.events(spark, sf_dir).select("event_id", "Label")
    ready = known.filter(F.col("entropy").isNotNull())
    train = ready.join(labels, "event_id")
    cut = K.two_means_1d(train, "entropy").groupBy("side").agg(F.max("entropy").alias("top"))
    threshold = cut.filter("side = 'A'").first()["top"]
    assign = lambda df: df.withColumn("cluster", (F.col("entropy") > threshold).cast("int"))
    purities = R.purity(assign(train), "cluster", F.col("Label") == "DDoS")
    model = M.fit_classifier(train, ["entropy", "value"], "Label", M.forest(10, 4))
    stream = S.read_stream(spark, *_written(ready), "*.parquet", 100)
    verdicts = S.two_stage_verdict(stream, assign, purities, 0.8, model, M.labels_of(model).index("DDoS"))
    out, _ = S.drain(verdicts.select("user_id", "event_id", "cluster", "route", "verdict"), "verdicts")
    return out.groupBy("route", "verdict").agg(F.count(F.lit(1)).alias("n"))


def _written(df):
    path = scratch_path(df.sparkSession, "entropies")
    df.write.parquet(path)
    return path, df.schema


TIME_SQL = """
c AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT start, n, n / sum(n) OVER (PARTITION BY start) AS p FROM c),
h AS (SELECT start, CAST(sum(n) AS BIGINT) AS n, round(greatest(0.0, -sum(p * log2(p))), 6) AS shannon, round(greatest(0.0, -log2(sum(p * p))), 6) AS renyi_2,
  round(greatest(0.0, -log2(max(p))), 6) AS min_entropy FROM p GROUP BY 1)
"""


@query(
    "time_window_entropy",
    f"WITH {TIME_SQL} SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, n, shannon, renyi_2, min_entropy FROM h",
)
def time_window_entropy(spark, sf_dir):
    out = S.time_window_entropy(B.table(spark, sf_dir, "events"), "ts", "event_type", "6 hours")
    named = out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")).drop("end")
    return rounded(named, "shannon", "renyi_2", "min_entropy")


@query(
    "stream_time_window_entropy",
    f"""WITH {TIME_SQL} SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, n, shannon, renyi_2, min_entropy FROM h
        WHERE start + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""",
)
def stream_time_window_entropy(spark, sf_dir):
    """The same on a stream: the windows that its watermark has closed."""
    stream = event_stream(spark, sf_dir)
    out, _ = S.drain(S.time_window_entropy(stream, "ts", "event_type", "6 hours", delay="1 hour"), "timewindows")
    named = out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")).drop("end")
    return rounded(named, "shannon", "renyi_2", "min_entropy")
