"""Column builders for cleaning, labels and derived flow features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BENIGN = "Benign"
ATTACK = "DDoS"
EPSILON = 1e-6

# The derived feature names and the flow columns they are made of.
PSH_RATIO = "PSH Flags Ratio"
PACKETS_PER_BYTE = "Flow Packets/Bytes Ratio"
TOTAL_PACKETS = "Total Packets"
ACTIVE_IDLE = "Active-Idle Mean Diff"

# The eight features whose entropy is measured.
FLOW_FEATURES = (
    "Protocol",
    "Flow Duration",
    PSH_RATIO,
    PACKETS_PER_BYTE,
    "Flow Bytes/s",
    TOTAL_PACKETS,
    "Flow IAT Mean",
    ACTIVE_IDLE,
)


def quoted(name: str) -> Column:
    """A column whose name may hold dots, blanks or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def number_or_zero(col: Column) -> Column:
    """Coerce to double; what is not a number becomes 0."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def integer_or_zero(col: Column, text: bool = False) -> Column:
    """Null, NaN, infinite or unreadable becomes 0; the rest is truncated toward zero."""
    number = col.try_cast("double") if text else col
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


def finite_or_null(col: Column) -> Column:
    """Infinite and NaN become null."""
    number = col.cast("double")
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~bad, number)


def collapse_label(label: Column, benign: str = BENIGN, attack: str = ATTACK) -> Column:
    """Everything that is not benign is one attack class."""
    return F.when(label == benign, F.lit(benign)).otherwise(F.lit(attack))


def one_vs_rest(label: Column, positive: str, other: str = "Other") -> Column:
    return F.when(label == positive, F.lit(positive)).otherwise(F.lit(other))


def label_bit(label: Column, positive: str = ATTACK) -> Column:
    """1 for the positive label, else 0."""
    return (label == positive).cast("int")


def derived_features() -> dict[str, Column]:
    """The four derived flow features, by name."""
    return {
        PSH_RATIO: quoted("Fwd PSH Flags") / (quoted("Bwd PSH Flags") + EPSILON),
        PACKETS_PER_BYTE: quoted("Flow Packets/s") / (quoted("Flow Bytes/s") + EPSILON),
        TOTAL_PACKETS: quoted("Total Fwd Packets") + quoted("Total Backward Packets"),
        ACTIVE_IDLE: quoted("Active Mean") - quoted("Idle Mean"),
    }


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def one_hot(label: Column, classes: Sequence[str]) -> dict[str, Column]:
    """One 0/1 column per class."""
    return {c: F.coalesce((label == c).cast("int"), F.lit(0)) for c in classes}


def arg_max(columns: Sequence[str]) -> Column:
    """Name of the largest of ``columns``; the first one wins a tie."""
    values = F.array(*[quoted(c).cast("double") for c in columns])
    position = F.array_position(values, F.array_max(values))
    return F.element_at(F.array(*[F.lit(c) for c in columns]), position.cast("int"))


def relative_improvement(base: Column, new: Column, lower_is_better: Column) -> Column:
    """Change from ``base`` in percent, positive when it is an improvement."""
    change = F.try_divide(new - base, F.abs(base)) * 100
    return F.when(lower_is_better, -change).otherwise(change)


def features_array(columns: Sequence[str]) -> Column:
    """Scalar columns as one ``array<double>``, the form the clustering operators take."""
    return F.array(*[quoted(c).cast("double") for c in columns])


def vector_length(features: Column) -> Column:
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda acc, x: acc + x * x))
