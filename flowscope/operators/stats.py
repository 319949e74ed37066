"""Outlier filters, scaling and distribution statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions import columns as C
from flowscope.functions.columns import quoted
from flowscope.operators.index import running_sums, single_row
from flowscope.session import cut_lineage

# Bits of a value's key that each pass over the table settles, from the highest.
DIGITS = (13, 13, 13, 13, 12)


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """64-bit keys that order as the numbers do: the bits of a double, negative ones turned round."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def value_of_key(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def digit_counts(batches: Iterator[pa.RecordBatch], spans: list[tuple[int, int]], known: int, digits: int) -> Iterator[pa.RecordBatch]:
    """How often each digit follows each (column, prefix of ``known`` bits) among a task's rows."""
    counts = np.zeros((len(spans), 1 << digits), np.int64)
    for batch in batches:
        for i in sorted({c for c, _ in spans}):
            values = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
            keys = ordered_keys(values[np.isfinite(values)])
            for s, (column, prefix) in enumerate(spans):
                if column == i:
                    mine = keys[keys >> np.uint64(64 - known) == np.uint64(prefix)] if known else keys
                    digit = (mine >> np.uint64(64 - known - digits)) & np.uint64((1 << digits) - 1)
                    counts[s] += np.bincount(digit.astype(np.int64), minlength=1 << digits)
    span, digit = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(span), pa.array(digit), pa.array(counts[span, digit])], ["span", "digit", "n"])


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation) of many columns without sorting or gathering a column.

    Radix selection: each of ``len(DIGITS)`` passes, whatever the range of the values, counts the next digit of the keys
    that share the digits found so far, for all columns and ranks at once. The driver sees counts of digits only, at most
    ``2 ** 13`` for a rank. Values that are not finite do not count.
    """
    rows = df.select(*(quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).persist()
    # Per (column, rank) the key's digits so far and the rank among the keys that share them.
    places: dict[tuple[int, int], tuple[int, int]] = {}
    needs: list[tuple[int, float, list[int]]] = []
    try:
        known = 0
        for digits in DIGITS:
            spans = sorted({(c, prefix) for (c, _), (prefix, _) in places.items()}) or [(i, 0) for i in range(len(columns))]
            counted = rows.mapInArrow(lambda it, s=spans, k=known, d=digits: digit_counts(it, s, k, d), "span long, digit long, n long")
            found: dict[tuple[int, int], list] = {}
            for r in sorted(counted.groupBy("span", "digit").agg(F.sum("n").alias("n")).collect()):
                found.setdefault(spans[r.span], []).append((r.digit, r.n))
            if not known:
                for i in range(len(columns)):
                    n = sum(m for _, m in found.get((i, 0), []))
                    for p in probs:
                        at = (n - 1) * p
                        ranks = sorted({max(0, math.floor(at)), max(0, math.ceil(at))}) if n else []
                        needs.append((i, at, ranks))
                        places |= {(i, r): (0, r) for r in ranks}
            for (i, rank), (prefix, rest) in places.items():
                for digit, n in found[i, prefix]:
                    if rest < n:
                        places[i, rank] = (prefix << digits | digit, rest)
                        break
                    rest -= n
            known += digits
            if not places:
                break
    finally:
        rows.unpersist()
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for i, at, ranks in needs:
        ends = [value_of_key(places[i, r][0]) for r in ranks]
        out[columns[i]].append(ends[0] + (ends[-1] - ends[0]) * (at - math.floor(at)) if ends else None)
    return out


def zscore_filter(df: DataFrame, features: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Keep rows with ``|z| < limit`` in every feature; a constant feature passes.

    Mean and deviation are those of the finite values. A row without a finite value in a feature is
    dropped, unless the feature is constant.
    """
    stats = single_row(
        df.agg(
            *[
                F.struct(F.avg(C.finite_or_null(quoted(f))).alias("mu"), F.stddev_pop(C.finite_or_null(quoted(f))).alias("sd")).alias(f"s{i}")
                for i, f in enumerate(features)
            ]
        )
    )
    tests = []
    for i, f in enumerate(features):
        mu, sd = F.col(f"_z.s{i}.mu"), F.col(f"_z.s{i}.sd")
        tests.append((sd == 0) | (F.abs(quoted(f) - mu) < F.lit(limit) * sd))
    return df.withColumn("_z", stats).filter(C.all_of(tests)).drop("_z")


def iqr_filter(df: DataFrame, features: Sequence[str], width: float = 1.5) -> DataFrame:
    """Drop rows outside ``[Q1 - width IQR, Q3 + width IQR]`` in any feature (exact quartiles)."""
    quartiles = exact_quantiles(df, features, [0.25, 0.75])
    tests = []
    for f in features:
        q1, q3 = quartiles[f]
        if q1 is None:
            continue
        span = width * (q3 - q1)
        tests.append(quoted(f).between(F.lit(q1 - span), F.lit(q3 + span)))
    return df.filter(C.all_of(tests))


def remove_outliers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Z-score filter, then IQR filter on the survivors."""
    return iqr_filter(zscore_filter(df, features), features)


@dataclass(frozen=True)
class Scaler:
    """Fitted centre and scale per column."""

    columns: tuple[str, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]

    def scaled(self, column: str) -> Column:
        i = self.columns.index(column)
        return (quoted(column).cast("double") - F.lit(self.center[i])) / F.lit(self.scale[i])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})


def fit_standard_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """Mean and population deviation; a constant column is only centred."""
    row = df.agg(
        *[
            F.struct(F.avg(C.finite_or_null(quoted(f))).alias("mu"), F.stddev_pop(C.finite_or_null(quoted(f))).alias("sd")).alias(f"s{i}")
            for i, f in enumerate(features)
        ]
    ).first()
    return Scaler(
        tuple(features),
        tuple(float(row[i]["mu"] or 0.0) for i in range(len(features))),
        tuple(float(row[i]["sd"] or 1.0) for i in range(len(features))),
    )


def fit_robust_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """Median and interquartile range (exact)."""
    q = exact_quantiles(df, features, [0.25, 0.5, 0.75])
    return Scaler(
        tuple(features),
        tuple(float(q[f][1] or 0.0) for f in features),
        tuple(float((q[f][2] or 0.0) - (q[f][0] or 0.0)) or 1.0 for f in features),
    )


def adaptive_contamination(
    df: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.1
) -> float:
    """Mean IQR of the standardised features over their overall range, clipped to [low, high]."""
    scaler = fit_standard_scaler(df, features)
    q = exact_quantiles(df, features, [0.0, 0.25, 0.75, 1.0])
    scaled = [
        [(v - m) / s for v in q[f]] for f, m, s in zip(features, scaler.center, scaler.scale, strict=True)
    ]
    mean_iqr = sum(s[2] - s[1] for s in scaled) / len(scaled)
    spread = max(s[3] for s in scaled) - min(s[0] for s in scaled)
    return min(max(mean_iqr / spread if spread else low, low), high)


def _normal_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    """Normal distribution function by a series / continued-fraction-free rational form of erfc.

    Fixed values: the erfc coefficients of Numerical Recipes (fractional error below 1.2e-7).
    """
    z = F.abs((x - mu) / sigma) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    coefficients = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = poly * t + F.lit(c)
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= mu, F.lit(1.0) - tail / 2).otherwise(tail / 2)


def ks_statistic(df: DataFrame, column: str) -> DataFrame:
    """``(n, mu, sigma, d)``: distance of a column from the normal law fitted to it.

    Works on value counts and two-level running sums, so neither ties nor size matter. Only finite
    values count.
    """
    x = C.finite_or_null(quoted(column).cast("double"))
    rows = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    counts = cut_lineage(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    fit = single_row(
        counts.agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mu"),
        )
    )
    centred = counts.withColumn("_f", fit)
    sigma = single_row(
        centred.agg(F.sqrt(F.sum(F.col("n") * F.pow(F.col("x") - F.col("_f.mu"), F.lit(2.0))) / F.sum("n")).alias("sigma"))
    )
    ranked = running_sums(counts, "x", {"upto": F.col("n")}).withColumns({"_f": fit, "_s": sigma})
    cdf = _normal_cdf(F.col("x"), F.col("_f.mu"), F.col("_s.sigma"))
    gaps = ranked.withColumn("_cdf", cdf).select(
        "_f",
        "_s",
        F.greatest(
            F.col("upto") / F.col("_f.n") - F.col("_cdf"),
            F.col("_cdf") - (F.col("upto") - F.col("n")) / F.col("_f.n"),
        ).alias("_gap"),
    )
    return gaps.agg(
        F.max("_f.n").alias("n"), F.max("_f.mu").alias("mu"), F.max("_s.sigma").alias("sigma"), F.max("_gap").alias("d")
    )


def normality_test(df: DataFrame, column: str, level: float = 0.05) -> DataFrame:
    """Kolmogorov-Smirnov test against the fitted normal law.

    The parameters come from the same data, so the p-value is optimistic; read ``d`` as well.
    """
    rows = df.select(C.finite_or_null(quoted(column).cast("double")).alias("x")).filter(F.col("x").isNotNull())
    mu, sigma = rows.agg(F.avg("x"), F.stddev_pop("x")).first()
    if not sigma:
        raise ValueError("a constant column has no normal fit")
    test = KolmogorovSmirnovTest.test(rows, "x", "norm", mu, sigma)
    return test.select(
        F.lit(column).alias("feature"),
        F.lit(mu).alias("mu"),
        F.lit(sigma).alias("sigma"),
        F.col("statistic").alias("d"),
        F.col("pValue").alias("p_value"),
        (F.col("pValue") > level).alias("normal"),
    )


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over the column's range: ``(by..., bin, n)`` with bins from 0.

    Empty bins have no row; the top edge belongs to the last bin.
    """
    x = quoted(column).cast("double")
    rows = df.select(*[quoted(b) for b in by], x.alias("_x")).filter(F.col("_x").isNotNull())
    span = single_row(rows.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    share = F.coalesce(F.try_divide(F.col("_x") - lo, hi - lo), F.lit(0.0))
    bin_no = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("bigint")
    return (
        rows.withColumn("_r", span)
        .groupBy(*[quoted(b) for b in by], bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def kernel_density(
    df: DataFrame, column: str, by: str, points: int = 100, bins: int = 1_000
) -> DataFrame:
    """Gaussian kernel density per class on an even grid: ``(by, x, density)``.

    Bandwidth by Scott's rule per class. The kernels sit on the centres of ``bins`` fine bins, so
    the work after one aggregate is ``classes x bins x points`` whatever the table size; the grid
    is widened by three bandwidths on both sides.
    """
    x = quoted(column).cast("double")
    rows = df.select(quoted(by).alias("_c"), x.alias("_x")).filter(F.col("_x").isNotNull())
    span = single_row(rows.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    width = F.greatest((hi - lo) / bins, F.lit(1e-12))
    bin_no = F.least(F.floor((F.col("_x") - lo) / width), F.lit(bins - 1))
    binned = rows.withColumn("_r", span).groupBy("_c", bin_no.alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"),
        F.first("_r").alias("_r"),
    )
    # One row per class with its bins as one bounded array.
    per = binned.groupBy("_c").agg(
        F.sum("n").alias("total"),
        F.sum("sx").alias("sx"),
        F.sum("sxx").alias("sxx"),
        F.min("_r.lo").alias("lo"),
        F.max("_r.hi").alias("hi"),
        F.collect_list(F.struct((F.col("sx") / F.col("n")).alias("at"), "n")).alias("mass"),
    )
    n = F.col("total").cast("double")
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / n) / (n - 1)
    h = F.sqrt(F.greatest(var, F.lit(1e-24))) * F.pow(n, F.lit(-0.2))
    grid = per.withColumn("_h", h).select(
        F.col("_c").alias(by),
        "_h",
        "total",
        "mass",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(points - 1)),
                lambda i: (F.col("lo") - 3 * F.col("_h"))
                + i * (F.col("hi") - F.col("lo") + 6 * F.col("_h")) / (points - 1),
            )
        ).alias("x"),
    )
    kernel = F.aggregate(
        "mass",
        F.lit(0.0),
        lambda acc, m: acc + m["n"] * F.exp(-0.5 * F.pow((F.col("x") - m["at"]) / F.col("_h"), F.lit(2.0))),
    )
    density = kernel / (F.col("total") * F.col("_h") * math.sqrt(2 * math.pi))
    return grid.select(by, "x", density.alias("density"))
