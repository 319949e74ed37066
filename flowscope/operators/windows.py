"""Row-window operators. Positions are dense; windows run inside bounded chunks with a halo."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.functions import entropy as E
from flowscope.functions.columns import quoted
from flowscope.operators.entropy import count_entropies
from flowscope.operators.index import single_row, with_halo
from flowscope.session import known_bytes

DEFAULT_CHUNK = 8_192
# Of the files below a table whose windows go to one task.
WINDOW_BYTES = 2 << 20


def histogram_bin(x: Column, bins: int = 50) -> Column:
    """Bin of a value in [0, 1]; 1.0 belongs to the last bin."""
    return F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1)).cast("bigint")


def sliding_entropies(
    df: DataFrame,
    idx: str,
    value: str,
    window: int,
    metrics: dict[str, str],
    entity: Sequence[str] = (),
    chunk: int | None = None,
    alpha: float = 2.0,
    base: float = 2.0,
) -> DataFrame:
    """Entropies of the last ``window`` rows at every row; null while the window is short.

    ``metrics`` names the columns of ``shannon``, ``renyi`` (of order ``alpha``) and ``min_entropy``,
    any of them, in units of ``log base``. Each row enters its window at its position and leaves it
    ``window`` positions later. What an event changes in ``sum(n log2 n)`` and ``sum(n^alpha)``
    depends only on the count of its value at that moment. The largest count is the number of levels
    that some value reaches, and an event changes one level. Running sums therefore give every window
    in time independent of ``window``. All of it stays in the JVM; one shuffle places the chunks.
    """
    unknown = set(metrics) - {"shannon", "renyi", "min_entropy"}
    if unknown or not metrics:
        raise ValueError(f"unknown metrics: {sorted(unknown)}" if unknown else "no metrics given")
    if "renyi" in metrics and alpha == 1.0:
        raise ValueError("the order of a Renyi entropy is not 1; take shannon")
    chunk = max(chunk or DEFAULT_CHUNK, window)
    pos = F.col(idx)
    here = [*entity, "_chunk"]
    # Placed by chunk once: the windows below then run without another shuffle.
    rows = with_halo(df.withColumn("_v", quoted(value)), idx, chunk, window - 1).repartition(*here)
    moves = F.explode(
        F.array(
            F.struct(pos.alias("at"), F.lit(1).alias("step")),
            F.struct((pos + window).alias("at"), F.lit(-1).alias("step")),
        )
    )
    events = rows.withColumn("_m", moves)

    def running(col: Column, *by: str) -> Column:
        w = Window.partitionBy(*here, *by).orderBy("_m.at", "_m.step")
        return F.sum(F.when(F.col("_v").isNotNull(), col)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    enters = F.col("_m.step") == 1
    events = events.withColumn("_n", running(F.col("_m.step"), "_v").cast("double"))

    def change(power) -> Column:
        now, other = power(F.col("_n")), power(F.when(enters, F.col("_n") - 1).otherwise(F.col("_n") + 1))
        return now - other

    sums = {"_size": running(F.col("_m.step"))}
    if "shannon" in metrics:
        sums["_logs"] = running(change(lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))))
    if "renyi" in metrics:
        sums["_powers"] = running(change(lambda n: F.when(n > 0, F.pow(n, F.lit(alpha))).otherwise(F.lit(0.0))))
    if "min_entropy" in metrics:
        # The level that a value comes to when it enters, and gives up when it leaves.
        events = events.withColumn("_level", F.when(enters, F.col("_n")).otherwise(F.col("_n") + 1))
        events = events.withColumn("_reached", running(F.col("_m.step"), "_level"))
        step = F.when(enters, F.when(F.col("_reached") == 1, 1).otherwise(0)).otherwise(F.when(F.col("_reached") == 0, -1).otherwise(0))
        sums["_top"] = running(step)
    size, unit = F.col("_size").cast("double"), F.lit(math.log2(base))
    forms = {
        "shannon": lambda: F.log2(size) - F.col("_logs") / size,
        "renyi": lambda: (F.log2(F.col("_powers")) - F.lit(alpha) * F.log2(size)) / F.lit(1.0 - alpha),
        "min_entropy": lambda: F.log2(size) - F.log2(F.col("_top").cast("double")),
    }
    full = pos >= window - 1
    out = [F.when(full, F.greatest(F.lit(0.0), F.coalesce(forms[m]() / unit, F.lit(0.0)))).alias(name) for m, name in metrics.items()]
    return events.withColumns(sums).filter(enters & F.col("_owned")).select(*df.columns, *out)


def sliding_entropy(
    df: DataFrame,
    idx: str,
    value: str,
    window: int,
    entity: Sequence[str] = (),
    chunk: int | None = None,
    name: str = "entropy",
) -> DataFrame:
    """Shannon entropy in bits of the last ``window`` rows at every row."""
    return sliding_entropies(df, idx, value, window, {"shannon": name}, entity, chunk)


def sliding_histogram_entropies(
    df: DataFrame,
    idx: str,
    value: str,
    window: int = 256,
    bins: int = 50,
    entity: Sequence[str] = (),
    chunk: int | None = None,
    metrics: dict[str, str] | None = None,
    alpha: float = 2.0,
    base: float = 2.0,
) -> DataFrame:
    """Sliding entropies of a value in [0, 1] cut into equal bins."""
    binned = df.withColumn("_bin", histogram_bin(quoted(value), bins))
    named = metrics or {m: m for m in ("shannon", "renyi", "min_entropy")}
    return sliding_entropies(binned, idx, "_bin", window, named, entity, chunk, alpha, base).drop("_bin")


def sliding_histogram_entropy(
    df: DataFrame,
    idx: str,
    value: str,
    window: int = 256,
    bins: int = 50,
    entity: Sequence[str] = (),
    chunk: int | None = None,
    name: str = "entropy",
) -> DataFrame:
    """Sliding entropy of a value in [0, 1] cut into equal bins."""
    binned = df.withColumn("_bin", histogram_bin(quoted(value), bins))
    return sliding_entropy(binned, idx, "_bin", window, entity, chunk, name).drop("_bin")


def tumbling_entropy(
    df: DataFrame,
    idx: str,
    features: Sequence[str],
    window: int = 100,
    metrics: Sequence[str] = ("shannon", "renyi_2", "min_entropy"),
    as_type: str = "double",
) -> DataFrame:
    """One vector per block of ``window`` rows: ``<feature>_<metric>`` for every feature.

    Rows are placed by window once. A window is bounded, so that is never a hot group, and the value
    counts, the entropies and the wide row then all aggregate in place without another shuffle. The
    long form comes from an array of structs, which keeps the placement (an unpivot would lose it).
    """
    block = F.expr(f"`{idx}` div {int(window)}").alias("window_id")
    placed = df.select(block, *[quoted(f).cast(as_type).alias(f"_f{i}") for i, f in enumerate(features)])
    pairs = F.array(
        *[F.struct(F.lit(i).alias("feature"), F.col(f"_f{i}").alias("value")) for i in range(len(features))]
    )
    # A task holds the counts of all its windows. Left to the session's number of partitions, they would grow with the table.
    parts = -(-known_bytes(df) // WINDOW_BYTES)
    enough = parts <= df.sparkSession.sparkContext.defaultParallelism
    placed = placed.repartition("window_id") if enough else placed.repartition(parts, "window_id")
    long = placed.select("window_id", F.inline(pairs))
    counts = (
        long.filter(F.col("value").isNotNull())
        .groupBy("window_id", "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    each = count_entropies(counts, ["window_id", "feature"], metrics)
    return each.groupBy("window_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("feature") == i, quoted(m))), F.lit(0.0)).alias(f"{f}_{m}")
            for i, f in enumerate(features)
            for m in metrics
        ]
    )


def attach_window_vectors(df: DataFrame, vectors: DataFrame, idx: str, window: int = 100) -> DataFrame:
    """Repeat each window's vector on its rows, by window id."""
    rows = df.withColumn("window_id", F.expr(f"`{idx}` div {int(window)}"))
    return rows.join(vectors, "window_id", "left")


def row_entropy_window_mean(
    df: DataFrame,
    idx: str,
    features: Sequence[str],
    method: str = "shannon",
    window: int = 100,
    name: str = "window_entropy",
) -> DataFrame:
    """Entropy of each row's features, averaged over fixed windows and repeated on their rows."""
    values = F.array(*[quoted(f).cast("bigint") for f in features])
    rows = df.withColumn("row_entropy", E.row_entropy(values, method)).withColumn(
        "window_id", F.expr(f"`{idx}` div {int(window)}")
    )
    return rows.withColumn(name, F.avg("row_entropy").over(Window.partitionBy("window_id")))


def slope(
    df: DataFrame,
    idx: str,
    value: str,
    entity: Sequence[str] = (),
    chunk: int = DEFAULT_CHUNK,
    name: str = "slope",
) -> DataFrame:
    """Change of ``value`` per step of the position; null on the first row."""
    rows = with_halo(df, idx, chunk, 1)
    w = Window.partitionBy(*entity, "_chunk").orderBy(idx)
    rise = quoted(value).cast("double") - F.lag(quoted(value).cast("double")).over(w)
    run = F.col(idx) - F.lag(idx).over(w)
    return (
        rows.withColumn(name, F.try_divide(rise, run.cast("double")))
        .filter("_owned")
        .select(*df.columns, name)
    )


def classify_by_sigma(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``Class_<feature>``: Low / Medium / High around mean +- sample sigma; null stays null."""
    bounds = single_row(
        df.agg(
            *[
                F.struct(F.avg(quoted(f)).alias("mu"), F.stddev_samp(quoted(f)).alias("sigma")).alias(f"s{i}")
                for i, f in enumerate(features)
            ]
        )
    )
    joined = df.withColumn("_s", bounds)
    classes = {}
    for i, f in enumerate(features):
        x, mu, sigma = quoted(f), F.col(f"_s.s{i}.mu"), F.col(f"_s.s{i}.sigma")
        classes[f"Class_{f}"] = (
            F.when(x < mu - sigma, "Low").when(x > mu + sigma, "High").when(x.isNotNull() & sigma.isNotNull(), "Medium")
        )
    return joined.withColumns(classes).drop("_s")


def class_shares(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of Low and High among the classified rows, one row per feature."""
    shares = df.agg(
        *[
            F.struct(
                F.try_divide(F.count_if(F.col(f"`Class_{f}`") == "Low"), F.count(F.col(f"`Class_{f}`"))).alias("low"),
                F.try_divide(F.count_if(F.col(f"`Class_{f}`") == "High"), F.count(F.col(f"`Class_{f}`"))).alias("high"),
            ).alias(f"_c{i}")
            for i, f in enumerate(features)
        ]
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_c{i}").alias("s")) for i, f in enumerate(features)])
    )
    return shares.select(pairs.alias("_p")).select(
        "_p.feature",
        F.col("_p.s.low").alias("low_proportion"),
        F.col("_p.s.high").alias("high_proportion"),
    )


def sequences(
    df: DataFrame,
    idx: str,
    features: Sequence[str],
    label: str,
    length: int,
    entity: Sequence[str] = (),
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Stride-1 sequences of ``length`` rows: ``(entity..., idx, sequence, label)`` at the last row.

    Raises when a feature is null, NaN or infinite.
    """
    values = []
    for f in features:
        x = quoted(f).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        values.append(F.when(bad, F.raise_error(F.lit(f"{f} is not finite")).cast("double")).otherwise(x))
    rows = with_halo(
        df.select(*[quoted(e) for e in entity], idx, quoted(label).alias("label"), F.array(*values).alias("_x")),
        idx,
        max(chunk, length),
        length - 1,
    )
    w = Window.partitionBy(*entity, "_chunk").orderBy(idx).rowsBetween(-(length - 1), 0)
    return (
        rows.withColumn("sequence", F.collect_list("_x").over(w))
        .filter(F.col("_owned") & (F.size("sequence") == length))
        .select(*entity, idx, "sequence", "label")
    )
