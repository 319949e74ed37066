"""Deterministic sampling and splitting by hash rank.

Exact quotas need the rank of a row in its stratum. A window per stratum would sort a hot label in
one task, so ranks are cut on a histogram of the hash instead: whole hash slots are in or out, and
only the one slot that the quota falls into is looked at by value, with equal rows counted as one.
Rows that repeat are told apart by number: where the quota falls among copies of one row, as many of
them are taken as are missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.functions.columns import any_of, quoted
from flowscope.operators.index import checked_broadcast, single_row

HASH_RANGE = 1 << 40
SLOTS = 1 << 16
# Rows of a stratum in one slot above which the slot is cut once more before its values are ordered.
FULL_SLOT = 1_000_000
# Copies of one row that a task writes out.
COPIES = 100_000


def hash_key(columns: Sequence[str], seed: int = 42) -> Column:
    """A repeatable hash of a row in ``[0, HASH_RANGE)``, independent of the partitioning."""
    return F.pmod(F.xxhash64(*[quoted(c) for c in columns], F.lit(seed)), F.lit(HASH_RANGE))


def uniform(columns: Sequence[str], seed: int = 42) -> Column:
    """A repeatable number in [0, 1) per row."""
    return hash_key(columns, seed) / float(HASH_RANGE)


def _slot(key: Column, key_range: int, slots: int) -> Column:
    width = max(1, -(-key_range // slots))
    return F.floor(key / width).cast("bigint")


def rank_thresholds(
    df: DataFrame,
    by: Sequence[str],
    key: Column,
    ties: Sequence[str],
    quota: Column,
    key_range: int = HASH_RANGE,
    slots: int = SLOTS,
) -> DataFrame:
    """The ``quota``-th smallest ``(key, ties...)`` of every stratum: ``(_by_0.., _threshold, _take, _copies)``.

    Of the ``_copies`` rows at the threshold, ``_take`` lie within the quota. Strata with quota 0 have
    no row. The result has one row per stratum and is computed here, so it may be joined any number
    of times.
    """
    renamed = {b: f"_by_{i}" for i, b in enumerate(by)}
    strata = list(renamed.values())
    placed = df.select(*[quoted(b).alias(r) for b, r in renamed.items()], _place(key, ties).alias("_place"))
    slotted = placed.withColumn("_slot", _slot(F.col("_place.key"), key_range, slots))
    sizes = slotted.groupBy(*strata, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    table = sizes.agg(F.sum("_n").alias("t")).scalar()
    wanted = sizes.withColumns({"n": F.sum("_n").over(Window.partitionBy(*strata)), "total": table})
    cuts = checked_broadcast(_cut(wanted.withColumn("_rest", quota.cast("bigint")), strata, "_slot"))
    edge = _inside(slotted, cuts, strata, "_slot")
    width = max(1, -(-key_range // slots))
    if width > 1 and cuts.filter(F.col("_n") > FULL_SLOT).limit(1).count():
        fine = edge.withColumn("_fine", _slot(F.pmod(F.col("_place.key"), F.lit(width)), width, slots))
        sizes = fine.groupBy(*strata, "_rest", "_fine").agg(F.count(F.lit(1)).alias("_n"))
        cuts = checked_broadcast(_cut(sizes, strata, "_fine"))
        edge = _inside(fine.drop("_rest"), cuts, strata, "_fine")
    values = edge.groupBy(*strata, "_rest", "_place").agg(F.count(F.lit(1)).alias("_n"))
    found = _cut(values, strata, "_place")
    return checked_broadcast(
        found.select(*strata, F.col("_place").alias("_threshold"), F.col("_rest").alias("_take"), F.col("_n").alias("_copies"))
    )


def _place(key: Column, ties: Sequence[str]) -> Column:
    return F.struct(key.alias("key"), *[quoted(t).alias(f"t{i}") for i, t in enumerate(ties)])


def _cut(counts: DataFrame, strata: list[str], at: str) -> DataFrame:
    """The value of ``at`` in which the ``_rest``-th row of each stratum falls, and the rest within it."""
    upto = Window.partitionBy(*strata).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counts.withColumn("_upto", F.sum("_n").over(upto))
    found = found.filter((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_n") < F.col("_rest")))
    return found.select(*strata, at, (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest"), "_n")


def _inside(rows: DataFrame, cuts: DataFrame, strata: list[str], at: str) -> DataFrame:
    """Rows in the slot of their stratum that a cut names, with the rest."""
    named = cuts.select(*[F.col(r).alias(f"_cut{r}") for r in strata], F.col(at).alias("_cut"), "_rest")
    same = [F.col(at) == F.col("_cut"), *[F.col(r).eqNullSafe(F.col(f"_cut{r}")) for r in strata]]
    return rows.join(named, same).select(*rows.columns, "_rest")


def _below(df: DataFrame, by: Sequence[str], key: Column, ties: Sequence[str], thresholds: DataFrame, name: str) -> DataFrame:
    """Flag the rows within the quota of their stratum; narrow apart from a small join.

    Only where a quota falls among copies of a row are those copies counted and written out again,
    ``COPIES`` a task.
    """
    strata = [f"_by_{i}" for i in range(len(by))]
    added = ["_threshold", "_take", "_copies"]
    if by:
        same = [quoted(b).eqNullSafe(F.col(r)) for b, r in zip(by, strata, strict=True)]
        joined = df.join(thresholds, same, "left").drop(*strata)
    else:
        row = single_row(thresholds)
        joined = df.withColumns({a: row[a] for a in added})
    place, whole = _place(key, ties), F.col("_take") == F.col("_copies")
    flag = (place < F.col("_threshold")) | ((place == F.col("_threshold")) & whole)
    flagged = joined.withColumn(name, F.coalesce(flag, F.lit(False)))
    if not thresholds.filter(~whole).limit(1).count():
        return flagged.drop(*added)
    split = F.coalesce((place == F.col("_threshold")) & ~whole, F.lit(False))
    columns = [quoted(c) for c in df.columns]
    alike = joined.filter(split).groupBy("_threshold", "_take", *columns).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_threshold", *[quoted(b) for b in by]).orderBy(*columns)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = alike.withColumn("_before", before).withColumn("_part", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")))
    number = F.explode(F.expr(f"sequence(_part * {COPIES}, least(_n, (_part + 1) * {COPIES}) - 1)"))
    copies = parts.repartition(*columns, "_part").withColumn("_number", number)
    copies = copies.select(*columns, (F.col("_before") + F.col("_number") < F.col("_take")).alias(name))
    return flagged.filter(~split).select(*columns, name).unionByName(copies)


def all_ties(df: DataFrame, ids: Sequence[str]) -> list[str]:
    """``ids`` and then all other columns that can be ordered, so that only copies of a row stay tied."""
    plain = [f.name for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))]
    return [*ids, *[c for c in plain if c not in ids]]


def flag_by_rank(
    df: DataFrame,
    by: Sequence[str],
    key: Column,
    ties: Sequence[str],
    quota: Column,
    key_range: int = HASH_RANGE,
    slots: int = SLOTS,
    name: str = "selected",
) -> DataFrame:
    """Mark the rows with the smallest ``key`` per stratum, exactly ``quota`` of them.

    ``quota`` is a Column over ``n`` (rows in the stratum) and ``total`` (rows in the table).
    ``ties`` settles equal keys, then all other columns do; copies of a row are taken by number.
    """
    ties = all_ties(df, ties)
    thresholds = rank_thresholds(df, by, key, ties, quota, key_range, slots)
    return _below(df, by, key, ties, thresholds, name)


def stratified_sample(
    df: DataFrame, label: str, fraction: float, ids: Sequence[str], seed: int = 42
) -> DataFrame:
    """Exactly ``round(fraction * n)`` rows of every label."""
    quota = F.round(F.col("n") * fraction)
    flagged = flag_by_rank(df, [label], hash_key(ids, seed), ids, quota)
    return flagged.filter("selected").drop("selected")


def bagged_sample(
    df: DataFrame, label: str, fraction: float, bags: int, ids: Sequence[str], seed: int = 42
) -> DataFrame:
    """Distinct union of ``bags`` stratified samples with different seeds.

    "Drawn by any bag" is an OR per row over exact thresholds; nothing is deduplicated by shuffle.
    """
    quota = F.round(F.col("n") * fraction)
    ties = all_ties(df, ids)
    out, drawn = df, []
    for bag in range(bags):
        key = hash_key(ids, seed + bag)
        thresholds = rank_thresholds(df, [label], key, ties, quota)
        out = _below(out, [label], key, ties, thresholds, f"_bag{bag}")
        drawn.append(F.col(f"_bag{bag}"))
    return out.filter(any_of(drawn)).drop(*[f"_bag{bag}" for bag in range(bags)])


def sampling_ratio(sampled: DataFrame, original: DataFrame) -> DataFrame:
    """``(n_original, n_sampled, ratio_pct)``."""
    n_original = original.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sampled.agg(F.count(F.lit(1)).alias("n_sampled")).select(
        n_original.alias("n_original"),
        "n_sampled",
        (F.col("n_sampled") * 100.0 / n_original).alias("ratio_pct"),
    )


def stratified_size(
    df: DataFrame,
    label: str,
    size: int,
    ids: Sequence[str],
    key: Column | None = None,
    key_range: int = HASH_RANGE,
    seed: int = 42,
) -> DataFrame:
    """About ``size`` rows with every label in proportion (quota ``round(size * n / total)``)."""
    if df.select(quoted(label)).distinct().limit(2).count() < 2:
        raise ValueError("a stratified sample needs at least two labels")
    quota = F.round(F.lit(float(size)) * F.col("n") / F.col("total"))
    chosen = hash_key(ids, seed) if key is None else key
    flagged = flag_by_rank(df, [label], chosen, ids, quota, key_range)
    return flagged.filter("selected").drop("selected")


def simple_sample(
    df: DataFrame, fraction: float, ids: Sequence[str], seed: int = 42, draw: Column | None = None
) -> DataFrame:
    """A repeatable share of the rows; ``draw`` replaces the hash by another number in [0, 1)."""
    return df.filter((uniform(ids, seed) if draw is None else draw) < fraction)


def stratified_split(
    df: DataFrame,
    label: str,
    test_fraction: float,
    ids: Sequence[str],
    key: Column | None = None,
    key_range: int = HASH_RANGE,
    seed: int = 42,
    name: str = "is_test",
) -> DataFrame:
    """Flag ``ceil(test_fraction * n)`` rows of every label as test rows."""
    quota = F.ceil(F.round(F.col("n") * F.lit(test_fraction), 6))
    chosen = hash_key(ids, seed) if key is None else key
    return flag_by_rank(df, [label], chosen, ids, quota, key_range, name=name)


def plain_split(
    df: DataFrame,
    test_fraction: float,
    ids: Sequence[str],
    seed: int = 42,
    draw: Column | None = None,
    name: str = "is_test",
) -> DataFrame:
    """Flag about ``test_fraction`` of the rows, row by row."""
    return df.withColumn(name, (uniform(ids, seed) if draw is None else draw) < test_fraction)


def fold_ids(
    df: DataFrame, folds: int, ids: Sequence[str], seed: int = 42, key: Column | None = None, name: str = "fold"
) -> DataFrame:
    """Fold number in ``[0, folds)`` for cross-validation."""
    chosen = hash_key(ids, seed) if key is None else key
    return df.withColumn(name, F.pmod(chosen, F.lit(folds)).cast("int"))


def random_mask(
    df: DataFrame, fraction: float, ids: Sequence[str], seed: int = 42, draw: Column | None = None
) -> DataFrame:
    """The rows of a repeatable random mask (0.8 in the stability check)."""
    return simple_sample(df, fraction, ids, seed, draw)


def hash_picks(df: DataFrame, ids: Sequence[str], draws: int, per_draw: int, seed: int = 42) -> DataFrame:
    """Candidates for ``draws`` samples of ``per_draw`` rows: ``(draw, h, row...)``.

    One hash places a row in at most one of as many draws as fit side by side in [0, 1); on a small
    table further hashes serve the remaining draws. A draw gets about twice its rows (all rows of a
    small table) and the caller keeps those with the smallest ``h``. One narrow pass.
    """
    n = max(df.count(), 1)
    share = min(1.0, (2.0 * per_draw + 64.0) / n)
    width = max(1, int(share * HASH_RANGE))
    side_by_side = max(1, HASH_RANGE // width)
    options = []
    for first in range(0, draws, side_by_side):
        h = hash_key(ids, seed + 7_919 * first)
        place = F.floor(h / width).cast("int") + first
        last = min(first + side_by_side, draws)
        options.append(F.when(place < last, F.struct(place.alias("draw"), h.alias("h"))))
    return df.select(
        F.explode(F.array_compact(F.array(*options))).alias("_o"), *[quoted(c) for c in df.columns]
    ).select("_o.draw", "_o.h", *[quoted(c) for c in df.columns])


def draw_seeds(df: DataFrame, k: int, ids: Sequence[str], candidates: int, seed: int = 42) -> DataFrame:
    """``k`` distinct rows for each of ``candidates`` candidates: ``(candidate, seed_no, row...)``."""
    picks = hash_picks(df, ids, candidates, k, seed).withColumnRenamed("draw", "candidate")
    rank = F.row_number().over(Window.partitionBy("candidate").orderBy("h", *[quoted(c) for c in ids]))
    return (
        picks.withColumn("seed_no", rank - 1)
        .filter(F.col("seed_no") < k)
        .select("candidate", "seed_no", *[quoted(c) for c in df.columns])
    )


def time_split(
    df: DataFrame,
    label: str,
    order: str,
    bounds: tuple[float, float],
    slice_width: int,
    name: str = "part",
) -> DataFrame:
    """Three-way split that keeps label shares and time coverage.

    The position axis is cut into slices of ``slice_width`` and every (label, slice) is divided in
    order: the first ``bounds[0]`` go to train, up to ``bounds[1]`` to val, the rest to test. A
    slice bounds the group, so no label is ever sorted as a whole.
    """
    grouped = df.withColumn("_slice", F.expr(f"`{order}` div {int(slice_width)}"))
    w = Window.partitionBy(quoted(label), "_slice")
    rank = F.row_number().over(w.orderBy(order))
    share = (rank - 1) / F.count(F.lit(1)).over(w)
    part = F.when(share < bounds[0], "train").when(share < bounds[1], "val").otherwise("test")
    return grouped.withColumn(name, part).drop("_slice")


def working_sample(
    df: DataFrame,
    size: int,
    ids: Sequence[str],
    seed: int = 42,
    key: Column | None = None,
    key_range: int = HASH_RANGE,
) -> DataFrame:
    """Exactly ``size`` rows (or all, if fewer) by hash rank."""
    quota = F.least(F.lit(size).cast("bigint"), F.col("total"))
    chosen = hash_key(ids, seed) if key is None else key
    flagged = flag_by_rank(df, [], chosen, ids, quota, key_range)
    return flagged.filter("selected").drop("selected")
