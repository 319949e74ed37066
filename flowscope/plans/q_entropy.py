"""Queries over the entropy family."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.functions import entropy as E
from flowscope.operators import entropy as O
from flowscope.plans import bindings as B
from flowscope.plans.q_report import rounded
from flowscope.plans.registry import query

COUNTS_SQL = """
c AS (SELECT user_id % 20 AS grp, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT grp, n, n / sum(n) OVER (PARTITION BY grp) AS p FROM c)
"""


def grouped_counts(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 20)
    return O.value_counts(df, ["grp"], ["event_type"], "string")


def one_entropy(name, metric, sql_expr):
    sql = f"WITH {COUNTS_SQL} SELECT grp, round(greatest(0.0, {sql_expr}), 6) AS value FROM p GROUP BY grp"

    @query(name, sql)
    def run(spark, sf_dir):
        out = grouped_counts(spark, sf_dir).groupBy("grp").agg(metric(F.col("n")).alias("value"))
        return rounded(out, "value")

    return run


one_entropy("shannon_entropy", E.shannon, "-sum(p * log2(p))")
one_entropy("renyi_entropy", E.renyi, "-log2(sum(p * p))")
one_entropy("renyi_half_entropy", lambda n: E.renyi(n, 0.5), "log2(sum(sqrt(p))) / 0.5")
one_entropy("min_entropy", E.min_entropy, "-log2(max(p))")
one_entropy("tsallis_entropy", E.tsallis, "(1 - sum(pow(p, 1.5))) / 0.5")


@query(
    "guarded_shannon",
    f"WITH {COUNTS_SQL} SELECT grp, round(-sum(p * log2(p + 1e-12)), 6) AS shannon FROM p GROUP BY grp",
)
def guarded_shannon(spark, sf_dir):
    return rounded(O.guarded_shannon(grouped_counts(spark, sf_dir), ["grp"]), "shannon")


@query(
    "smoothed_shannon",
    """WITH b AS (SELECT user_id % 20 AS grp, least(floor(least(value / 500, 1.0) * 50), 49) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
       g AS (SELECT DISTINCT grp FROM b), f AS (SELECT g.grp, r.bin FROM g, (SELECT unnest(range(50)) AS bin) r),
       h AS (SELECT f.grp, coalesce(b.n, 0) AS n FROM f LEFT JOIN b ON f.grp = b.grp AND f.bin = b.bin),
       s AS (SELECT grp, (n / sum(n) OVER (PARTITION BY grp) + 0.001) / 1.05 AS q FROM h)
       SELECT grp, round(-sum(q * ln(q)), 6) AS entropy FROM s GROUP BY grp""",
)
def smoothed_shannon(spark, sf_dir):
    from flowscope.operators.windows import histogram_bin

    df = B.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("grp"), histogram_bin(F.least(F.col("value") / 500, F.lit(1.0))).alias("bin")
    )
    counts = df.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
    return rounded(O.smoothed_shannon(counts, ["grp"], 50, 0.001, 2.718281828459045), "entropy")


HAAR_SQL = """
s0 AS (SELECT event_id AS i, value AS x FROM events),
l1 AS (SELECT i // 2 AS i, max(x) FILTER (i % 2 = 0) AS a, coalesce(max(x) FILTER (i % 2 = 1), max(x) FILTER (i % 2 = 0)) AS b FROM s0 GROUP BY 1),
s1 AS (SELECT i, (a + b) / sqrt(2) AS x FROM l1),
l2 AS (SELECT i // 2 AS i, max(x) FILTER (i % 2 = 0) AS a, coalesce(max(x) FILTER (i % 2 = 1), max(x) FILTER (i % 2 = 0)) AS b FROM s1 GROUP BY 1),
s2 AS (SELECT i, (a + b) / sqrt(2) AS x FROM l2),
l3 AS (SELECT i // 2 AS i, max(x) FILTER (i % 2 = 0) AS a, coalesce(max(x) FILTER (i % 2 = 1), max(x) FILTER (i % 2 = 0)) AS b FROM s2 GROUP BY 1),
e AS (SELECT sum(pow((a + b) / sqrt(2), 2)) AS v FROM l3 UNION ALL SELECT sum(pow((a - b) / sqrt(2), 2)) FROM l3
      UNION ALL SELECT sum(pow((a - b) / sqrt(2), 2)) FROM l2 UNION ALL SELECT sum(pow((a - b) / sqrt(2), 2)) FROM l1)
"""


@query(
    "wavelet_entropy",
    f"""WITH {HAAR_SQL} SELECT round(-sum(v / t * log2(v / t)), 6) AS wavelet_entropy FROM e, (SELECT sum(v) AS t FROM e)""",
)
def wavelet_entropy(spark, sf_dir):
    df = B.table(spark, sf_dir, "events")
    return rounded(O.wavelet_entropy(df, [], "event_id", "value"), "wavelet_entropy")


@query(
    "fourier_energy",
    "SELECT event_type, round(count(value) * sum(value * value), 0) AS energy FROM events GROUP BY 1",
)
def fourier_energy(spark, sf_dir):
    df = B.table(spark, sf_dir, "events")
    return df.groupBy("event_type").agg(F.round(E.fourier_energy(F.col("value")), 0).alias("energy"))


@query(
    "skewness",
    """WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS mu FROM events)
       SELECT event_type, round(avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5), 6) AS value FROM m GROUP BY 1""",
)
def skewness(spark, sf_dir):
    df = B.table(spark, sf_dir, "events")
    return rounded(df.groupBy("event_type").agg(E.skewness(F.col("value")).alias("value")), "value")


@query(
    "kurtosis",
    """WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS mu FROM events)
       SELECT event_type, round(avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3, 6) AS value FROM m GROUP BY 1""",
)
def kurtosis(spark, sf_dir):
    df = B.table(spark, sf_dir, "events")
    return rounded(df.groupBy("event_type").agg(E.kurtosis(F.col("value")).alias("value")), "value")


MEASURED = list(C.FLOW_FEATURES)
FEATURES_SQL = f"""{B.FLOWS_SQL}, {B.DERIVED_SQL}, ints AS (SELECT "Family" AS family, "Label" AS label,
  {", ".join(f'CAST(trunc("{f}") AS BIGINT) AS "{f}"' for f in MEASURED)} FROM derived),
long AS (UNPIVOT ints ON {", ".join(f'"{f}"' for f in MEASURED)} INTO NAME feature VALUE v)
"""


def integer_features(spark, sf_dir):
    df = B.flows(spark, sf_dir).withColumns(C.derived_features())
    return df.select(
        F.col("Family").alias("family"), F.col("Label").alias("label"), *[C.integer_or_zero(C.quoted(f)).alias(f) for f in MEASURED]
    )


@query(
    "attack_entropy_choice",
    f"""WITH {FEATURES_SQL}, c AS (SELECT family, feature, v, count(*) AS n FROM long WHERE family IN ('Syn', 'UDP') GROUP BY ALL),
        p AS (SELECT family, feature, n / sum(n) OVER (PARTITION BY family, feature) AS p FROM c)
        SELECT family, feature, CASE family WHEN 'Syn' THEN 'renyi' ELSE 'shannon' END AS method,
          round(CASE family WHEN 'Syn' THEN -log2(sum(p * p)) ELSE -sum(p * log2(p)) END, 6) AS value FROM p GROUP BY family, feature""",
)
def attack_entropy_choice(spark, sf_dir):
    """The entropy that the registry picks for each attack family."""
    df = integer_features(spark, sf_dir)
    counts = O.value_counts(df.filter(F.col("family").isin("Syn", "UDP")), ["family"], MEASURED)
    metric = {"renyi": E.renyi, "shannon": E.shannon, "min": E.min_entropy}
    chosen = {f: E.ENTROPY_OF_ATTACK[f] for f in ("Syn", "UDP")}
    wide = counts.groupBy("family", "feature").agg(*[metric[m](F.col("n")).alias(m) for m in sorted(set(chosen.values()))])
    method, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for family, m in chosen.items():
        method = F.when(F.col("family") == family, m).otherwise(method)
        value = F.when(F.col("family") == family, F.col(m)).otherwise(value)
    return wide.select("family", "feature", method.alias("method"), F.round(value, 6).alias("value"))


@query(
    "feature_metric_matrix",
    f"""WITH {FEATURES_SQL}, u AS (SELECT feature, CAST(v AS DOUBLE) AS v FROM long WHERE family = 'UDP'),
        c AS (SELECT feature, v, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT feature, n, n / sum(n) OVER (PARTITION BY feature) AS p FROM c),
        m AS (SELECT feature, v, avg(v) OVER (PARTITION BY feature) AS mu FROM u),
        k AS (SELECT feature, coalesce(avg(pow(v - mu, 3)) / nullif(pow(avg(pow(v - mu, 2)), 1.5), 0), 0) AS sk FROM m GROUP BY 1),
        e AS (SELECT feature, greatest(0.0, -sum(p * log2(p))) AS h1, greatest(0.0, -log2(sum(p * p))) AS h2 FROM p GROUP BY 1)
        SELECT feature, round(h1, 6) AS shannon, round(h2, 6) AS renyi_2, round(sk, 5) AS skewness FROM e JOIN k USING (feature)""",
)
def feature_metric_matrix(spark, sf_dir):
    df = integer_features(spark, sf_dir).filter(F.col("family") == "UDP")
    out = O.feature_metrics(df, MEASURED, ["shannon", "renyi_2", "skewness"])
    return rounded(out, "shannon", "renyi_2").withColumn("skewness", F.round("skewness", 5))


PROFILE_SQL = f"""{FEATURES_SQL}, pc AS (SELECT family, feature, v, count(*) AS n FROM long GROUP BY ALL),
pp AS (SELECT family, feature, n / sum(n) OVER (PARTITION BY family, feature) AS p FROM pc),
prof AS (SELECT family, feature, greatest(0.0, -sum(p * log2(p))) AS shannon, greatest(0.0, -log2(sum(p * p))) AS renyi_2, greatest(0.0, -log2(max(p))) AS min_entropy
  FROM pp GROUP BY ALL)
"""


@query(
    "entropy_profile",
    f"""WITH {PROFILE_SQL}, l AS (UNPIVOT prof ON shannon, renyi_2, min_entropy INTO NAME entropy VALUE value)
        SELECT family, feature, entropy, round(value, 6) AS value FROM l""",
)
def entropy_profile(spark, sf_dir):
    return rounded(O.entropy_profile(integer_features(spark, sf_dir), ["family"], MEASURED), "value")


@query(
    "entropy_ordering",
    f"""WITH {PROFILE_SQL} SELECT family, feature, round(shannon, 6) AS shannon, round(renyi_2, 6) AS renyi_2,
        round(min_entropy, 6) AS min_entropy, TRUE AS ordered FROM prof""",
)
def entropy_ordering(spark, sf_dir):
    profile = O.entropy_profile(integer_features(spark, sf_dir), ["family"], MEASURED)
    return rounded(O.ordering_check(profile, ["family", "feature"]), "shannon", "renyi_2", "min_entropy")


@query(
    "low_entropy_features",
    f"""WITH {FEATURES_SQL}, c AS (SELECT feature, v, count(*) AS n FROM long WHERE label = 'DDoS' GROUP BY ALL),
        p AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p FROM c)
        SELECT feature, round(greatest(0.0, -sum(p * log2(p))), 6) AS shannon FROM p GROUP BY 1 ORDER BY 2, 1 LIMIT 4""",
)
def low_entropy_features(spark, sf_dir):
    """The half of the features with the lowest entropy given the attack label."""
    return rounded(O.select_by_entropy(integer_features(spark, sf_dir), "label", "DDoS", MEASURED, 0.5), "shannon")


@query(
    "attack_metric_matrix",
    f"""WITH {FEATURES_SQL}, u AS (SELECT feature, CAST(v AS DOUBLE) AS v FROM long WHERE family = 'Syn'),
        c AS (SELECT feature, v, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p FROM c),
        e AS (SELECT feature, greatest(0.0, -sum(p * log2(p))) AS h FROM p GROUP BY 1), m AS (SELECT feature, v, avg(v) OVER (PARTITION BY feature) AS mu FROM u),
        k AS (SELECT feature, coalesce(avg(pow(v - mu, 3)) / nullif(pow(avg(pow(v - mu, 2)), 1.5), 0), 0) AS sk FROM m GROUP BY 1)
        SELECT feature, round(h, 6) AS shannon, round(sk, 5) AS skewness FROM e JOIN k USING (feature)""",
)
def attack_metric_matrix(spark, sf_dir):
    """The metrics that the registry prescribes for one attack family."""
    out = O.attack_metrics(integer_features(spark, sf_dir), "family", "Syn", MEASURED)
    return rounded(out, "shannon").withColumn("skewness", F.round("skewness", 5))
