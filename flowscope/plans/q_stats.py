"""Queries over outliers, scaling, reduction and densities."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowscope.operators import iforest as I
from flowscope.operators import reduce as D
from flowscope.operators import stats as S
from flowscope.plans import bindings as B
from flowscope.plans.q_report import rounded
from flowscope.plans.registry import query

NUMBERS = ["o_totalprice", "o_custkey"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

ZSCORE_SQL = """
s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(user_id) AS mu, stddev_pop(user_id) AS su FROM events),
z AS (SELECT e.* FROM events e, s WHERE abs(value - mv) < 3 * sv AND abs(user_id - mu) < 3 * su),
q AS (SELECT quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3, quantile_cont(CAST(user_id AS DOUBLE), 0.25) AS u1,
  quantile_cont(CAST(user_id AS DOUBLE), 0.75) AS u3 FROM z),
k AS (SELECT z.* FROM z, q WHERE value BETWEEN v1 - 1.5 * (v3 - v1) AND v3 + 1.5 * (v3 - v1)
  AND user_id BETWEEN u1 - 1.5 * (u3 - u1) AND u3 + 1.5 * (u3 - u1))
"""


@query("zscore_filter", f"WITH {ZSCORE_SQL} SELECT event_id, value, user_id FROM z")
def zscore_filter(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    return S.zscore_filter(df, ["value", "user_id"])


@query("iqr_filter", f"WITH {ZSCORE_SQL} SELECT event_id, value, user_id FROM k")
def iqr_filter(spark, sf_dir):
    """Z-score filter, then IQR filter on its survivors."""
    df = B.table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    return S.remove_outliers(df, ["value", "user_id"])


@query(
    "exact_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.01), 6) AS q01, round(quantile_cont({c}, 0.5), 6) AS q50, "
        f"round(quantile_cont({c}, 0.99), 6) AS q99 FROM lineitem"
        for c in LINE
    ),
)
def exact_quantiles(spark, sf_dir):
    q = S.exact_quantiles(B.table(spark, sf_dir, "lineitem"), LINE, [0.01, 0.5, 0.99])
    rows = [(c, *[round(v, 6) for v in q[c]]) for c in LINE]
    return spark.createDataFrame(rows, "feature string, q01 double, q50 double, q99 double")


@query(
    "adaptive_contamination",
    """WITH x AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
         (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b,
         (l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER () AS c,
         (l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER () AS d FROM lineitem),
       q AS (SELECT ((quantile_cont(a, 0.75) - quantile_cont(a, 0.25)) + (quantile_cont(b, 0.75) - quantile_cont(b, 0.25))
         + (quantile_cont(c, 0.75) - quantile_cont(c, 0.25)) + (quantile_cont(d, 0.75) - quantile_cont(d, 0.25))) / 4 AS iqr,
         greatest(max(a), max(b), max(c), max(d)) - least(min(a), min(b), min(c), min(d)) AS spread FROM x)
       SELECT round(least(greatest(iqr / spread, 0.01), 0.9), 6) AS contamination FROM q""",
)
def adaptive_contamination(spark, sf_dir):
    value = S.adaptive_contamination(B.table(spark, sf_dir, "lineitem"), LINE, 0.01, 0.9)
    return spark.createDataFrame([(round(value, 6),)], "contamination double")


@query("isolation_outliers")
def isolation_outliers(spark, sf_dir):
    """Rows before and after the isolation-forest filter on all line items."""
    df = B.table(spark, sf_dir, "lineitem")
    scaler = S.fit_standard_scaler(df, LINE)
    x = df.select(*B.LINE_IDS, F.array(*[scaler.scaled(c) for c in LINE]).alias("features"))
    return I.removal_counts(I.flag_outliers(x, B.LINE_IDS, 0.05))


@query(
    "standard_scaled",
    "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) + 0.0 AS value FROM events",
)
def standard_scaled(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", "value")
    out = S.fit_standard_scaler(df, ["value"]).transform(df)
    return out.select("event_id", (F.round("value", 6) + 0.0).alias("value"))


@query(
    "robust_scaled",
    """WITH q AS (SELECT quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM events)
       SELECT event_id, round((value - m) / w, 6) + 0.0 AS value FROM events, q""",
)
def robust_scaled(spark, sf_dir):
    df = B.table(spark, sf_dir, "events").select("event_id", "value")
    out = S.fit_robust_scaler(df, ["value"]).transform(df)
    return out.select("event_id", (F.round("value", 6) + 0.0).alias("value"))


@query("pca_to_variance")
def pca_to_variance(spark, sf_dir):
    """Explained shares of the components kept for 80 % of the variance."""
    df = B.table(spark, sf_dir, "lineitem")
    return D.fit_pca_to_variance(df, [*LINE, "l_linenumber"], 0.8).variance_table(df)


@query("pca_loadings")
def pca_loadings(spark, sf_dir):
    df = B.table(spark, sf_dir, "lineitem")
    return D.fit_pca(df, LINE, 4).loadings(df)


@query(
    "pca_component_variance",
    """WITH z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
         (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem)
       SELECT round(1 + abs(corr(a, b)), 6) AS first, round(1 - abs(corr(a, b)), 6) AS second FROM z""",
)
def pca_component_variance(spark, sf_dir):
    """Variances of the two components of two standardised columns: 1 +- |correlation|."""
    df = B.table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    out = D.fit_pca(df, ["l_quantity", "l_extendedprice"], 2).transform(df).withColumn("c", vector_to_array("components"))
    return out.agg(F.round(F.var_pop(F.col("c")[0]), 6).alias("first"), F.round(F.var_pop(F.col("c")[1]), 6).alias("second"))


@query(
    "ks_statistic",
    """WITH s AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd, count(*) AS n FROM orders),
       r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS i FROM orders),
       z AS (SELECT x, i, n, mu, sd, abs(x - mu) / sd / sqrt(2) AS z FROM r, s), t AS (SELECT *, 1 / (1 + 0.5 * z) AS t FROM z),
       c AS (SELECT *, t * exp(-z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806
         + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))) AS e FROM t),
       f AS (SELECT i, n, mu, sd, CASE WHEN x >= mu THEN 1 - e / 2 ELSE e / 2 END AS cdf FROM c)
       SELECT max(n) AS n, round(max(mu), 3) AS mu, round(max(sd), 3) AS sigma, round(max(greatest(i / n - cdf, cdf - (i - 1) / n)), 6) AS d FROM f""",
)
def ks_statistic(spark, sf_dir):
    out = S.ks_statistic(B.table(spark, sf_dir, "orders"), "o_totalprice")
    return out.select("n", F.round("mu", 3).alias("mu"), F.round("sigma", 3).alias("sigma"), F.round("d", 6).alias("d"))


@query("normality_test")
def normality_test(spark, sf_dir):
    """Kolmogorov-Smirnov test of the price against its own normal fit."""
    return S.normality_test(B.table(spark, sf_dir, "orders"), "o_totalprice")


DENSITY_SQL = """
s AS (SELECT event_type, least(floor((value - (SELECT min(value) FROM events)) / ((SELECT max(value) - min(value) FROM events) / 200)), 199) AS b, value FROM events),
m AS (SELECT event_type, b, count(*) AS n, avg(value) AS a FROM s GROUP BY 1, 2),
h AS (SELECT event_type, count(*) AS t, stddev_samp(value) * pow(count(*), -0.2) AS h FROM events GROUP BY 1),
r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
g AS (SELECT h.event_type, h, t, (SELECT min(value) FROM events) - 3 * h + i * ((SELECT max(value) - min(value) FROM events) + 6 * h) / 24 AS x
  FROM h, (SELECT unnest(range(25)) AS i))
"""


@query(
    "class_density",
    f"""WITH {DENSITY_SQL} SELECT g.event_type, round(x, 6) AS x, round(sum(n * exp(-0.5 * pow((x - a) / h, 2))) / (max(t) * max(h) * sqrt(2 * pi())), 9) AS density
        FROM g JOIN m USING (event_type) GROUP BY 1, 2""",
)
def class_density(spark, sf_dir):
    """Kernel density of the value per event type on 25 grid points."""
    out = S.kernel_density(B.table(spark, sf_dir, "events"), "value", "event_type", 25, 200)
    return out.select("event_type", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query(
    "histogram",
    """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       SELECT o_orderstatus, CAST(least(floor((o_totalprice - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, count(*) AS n FROM orders, r GROUP BY 1, 2""",
)
def histogram(spark, sf_dir):
    return S.histogram(B.table(spark, sf_dir, "orders"), "o_totalprice", 30, ["o_orderstatus"])


@query("preprocessed_components")
def preprocessed_components(spark, sf_dir):
    """Outliers removed, scaled and reduced; the surviving ids with their first component."""
    df = B.table(spark, sf_dir, "orders")
    out, _ = D.preprocess(df, NUMBERS, "o_orderkey")
    return out.select("o_orderkey", F.round(vector_to_array("components")[0], 6).alias("first"))
