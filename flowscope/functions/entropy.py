"""Entropies as aggregate Columns over value counts.

Input is one row per (group, value) with a count ``n``; every builder returns an aggregate
expression for ``groupBy(group).agg(...)``. Both levels of grouping combine on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the guard inside the logarithm of the epsilon form.
LOG_GUARD = 1e-12


def _clean(col: Column) -> Column:
    """Empty groups and the rounding below zero of constant groups give 0."""
    return F.greatest(F.lit(0.0), F.coalesce(col, F.lit(0.0)))


def shannon(n: Column) -> Column:
    """Shannon entropy in bits: ``log2 N - sum(n log2 n) / N``, one pass."""
    total = F.sum(n).cast("double")
    return _clean(F.log2(total) - F.sum(n * F.log2(n.cast("double"))) / total)


def shannon_guarded(p: Column, eps: float = LOG_GUARD) -> Column:
    """``-sum p log2(p + eps)`` over rows that already hold shares."""
    return _clean(-F.sum(p * F.log2(p + F.lit(eps))))


def shannon_smoothed(n: Column, total: Column, bins: int, smoothing: float, base: float, renormalise: bool = True) -> Column:
    """Entropy of a histogram of ``bins`` bins with ``smoothing`` added to every share.

    Shares are renormalised unless told otherwise. ``n`` are the filled bins; the empty ones are
    counted in.
    """
    norm = 1.0 + bins * smoothing if renormalise else 1.0

    def term(share: Column) -> Column:
        p = (share + F.lit(smoothing)) / F.lit(norm)
        return -p * F.log(p) / F.lit(math.log(base))

    empty = F.lit(bins) - F.count(n)
    return _clean(F.sum(term(n / total)) + empty * term(F.lit(0.0)))


def renyi(n: Column, alpha: float = 2.0, base: float = 2.0) -> Column:
    """Renyi entropy from counts: ``(log2 sum n^a - a log2 N) / (1 - a)``, one pass, in ``log base``."""
    unit = F.lit(math.log2(base))
    if alpha == 1.0:
        return shannon(n) / unit
    total = F.sum(n).cast("double")
    moment = F.log2(F.sum(F.pow(n.cast("double"), F.lit(alpha))))
    return _clean((moment - F.lit(alpha) * F.log2(total)) / F.lit(1.0 - alpha) / unit)


def min_entropy(n: Column) -> Column:
    """``-log2`` of the largest share."""
    return _clean(F.log2(F.sum(n).cast("double")) - F.log2(F.max(n).cast("double")))


def tsallis(n: Column, q: float = 1.5) -> Column:
    """Tsallis entropy of order ``q``: ``(1 - sum p^q) / (q - 1)``."""
    total = F.sum(n).cast("double")
    moment = F.sum(F.pow(n.cast("double"), F.lit(q))) / F.pow(total, F.lit(q))
    return _clean((F.lit(1.0) - moment) / F.lit(q - 1.0))


# Count-based metrics by name; a caller names what it wants and only that enters the plan.
COUNT_METRICS: dict[str, Callable[[Column], Column]] = {
    "shannon": shannon,
    "renyi_2": renyi,
    "tsallis_1.5": tsallis,
    "min_entropy": min_entropy,
}


def skewness(x: Column) -> Column:
    """Population skewness; 0 for a constant or empty group."""
    spread = F.stddev_pop(x)
    return F.when(spread > 0, F.coalesce(F.skewness(x), F.lit(0.0))).otherwise(F.lit(0.0))


def kurtosis(x: Column) -> Column:
    """Population excess kurtosis; 0 for a constant or empty group."""
    spread = F.stddev_pop(x)
    return F.when(spread > 0, F.coalesce(F.kurtosis(x), F.lit(0.0))).otherwise(F.lit(0.0))


def fourier_energy(x: Column) -> Column:
    """Sum of squared Fourier magnitudes; by Parseval ``N * sum(x^2)``, so no transform is run."""
    return F.coalesce(F.count(x) * F.sum(x * x), F.lit(0.0))


# Metrics of the values themselves, not of their counts.
VALUE_METRICS: dict[str, Callable[[Column], Column]] = {
    "skewness": skewness,
    "kurtosis": kurtosis,
    "fourier_energy": fourier_energy,
}

# The row entropy chosen for each attack family.
ENTROPY_OF_ATTACK = {
    "LDAP": "renyi",
    "MSSQL": "shannon",
    "NetBIOS": "min",
    "Portmap": "min",
    "Syn": "renyi",
    "UDP": "shannon",
    "UDPLag": "renyi",
    "DNS": "shannon",
    "NTP": "min",
    "SNMP": "min",
    "TFTP": "shannon",
}

# The metrics measured for each attack family.
METRICS_OF_ATTACK = {
    "Syn": ("shannon", "skewness"),
    "UDP": ("shannon", "renyi_2", "wavelet_entropy"),
    "UDPLag": ("fourier_energy", "skewness"),
    "DNS": ("min_entropy", "wavelet_entropy", "skewness"),
    "NTP": ("skewness", "kurtosis"),
    "LDAP": ("tsallis_1.5", "renyi_2"),
    "MSSQL": ("tsallis_1.5", "skewness"),
    "NetBIOS": ("shannon",),
    "Portmap": ("renyi_2",),
    "TFTP": ("fourier_energy", "wavelet_entropy"),
}


def row_distribution(values: Column) -> Column:
    """Counts of the distinct entries of an array, one row's features read as a multiset."""
    return F.transform(
        F.array_distinct(values),
        lambda v: F.size(F.filter(values, lambda x: x == v)).cast("double"),
    )


def row_entropy(values: Column, method: str = "shannon", alpha: float = 2.0) -> Column:
    """Entropy of the multiset in one row's array."""
    counts = row_distribution(values)
    total = F.size(values).cast("double")
    plus = lambda acc, x: acc + x
    if method == "shannon" or (method == "renyi" and alpha == 1.0):
        logs = F.aggregate(F.transform(counts, lambda n: n * F.log2(n)), F.lit(0.0), plus)
        value = F.log2(total) - logs / total
    elif method == "renyi":
        moment = F.aggregate(F.transform(counts, lambda n: F.pow(n / total, F.lit(alpha))), F.lit(0.0), plus)
        value = F.log2(moment) / F.lit(1.0 - alpha)
    elif method == "min":
        value = F.log2(total) - F.log2(F.array_max(counts))
    else:
        raise ValueError(f"unknown entropy method: {method}")
    return F.when(F.size(values) > 0, _clean(value)).otherwise(F.lit(0.0))


def check_metrics(names: Sequence[str]) -> None:
    """Reject unknown metric names before a plan is built."""
    known = set(COUNT_METRICS) | set(VALUE_METRICS) | {"wavelet_entropy"}
    unknown = [m for m in names if m not in known]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
