"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document.

1. One scan turns every text into ``NAMES`` statistics, transformed by logarithms and square roots.
2. Counts, sums and products of the labelled rows are summed per class in Spark; the driver gets one row per class. Class
   covariances are shrunk towards the pooled covariance (``POOLED``) and that towards its diagonal (``DIAGONAL``).
3. With the Cholesky factor of each class cached, a score is the logistic of the difference of the two Gaussian log
   densities (squared Mahalanobis distance and log determinant) per statistic, plus the log odds of the classes.

Defined cases: a null or empty text has all statistics zero and is scored like any other; without labelled rows of both
classes the score is the share of label 1 among the labelled (0.5 without any); every row of a repeated id gets its own
result, a null id is not held out; null labels teach nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import quoted, table, text_buffers
from flowscope.plans.registry import query

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
POOLED, DIAGONAL = 0.1, 0.02
SLICE = 1 << 20
NAMES = ("words", "word_length", "upper", "digits", "marks", "symbols", "blanks", "beyond_ascii", "lines", "fresh_words", "top_word", "fresh_lines", "same_marks")
SIZE = len(NAMES)

# Classes of bytes.
BLANK, UPPER, LOWER, DIGIT, MARK, SYMBOL, HIGH, OTHER = range(8)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
CLASS[ord("A") : ord("Z") + 1] = UPPER
CLASS[ord("a") : ord("z") + 1] = LOWER
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = MARK
CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = SYMBOL
CLASS[128:] = HIGH


def spread_hash(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    which = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = (raw[starts[which] + place].astype(np.uint64) + np.uint64(1)) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.zeros(len(starts), np.uint64)
    full = lengths > 0
    total[full] = np.add.reduceat(value, (np.cumsum(lengths) - lengths)[full])
    return total


def distinct_and_top(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of distinct hashes and how often the commonest occurs."""
    distinct, top = np.zeros(rows), np.zeros(rows)
    if len(hashes):
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
        runs = np.diff(np.append(first, len(h)))
        distinct += np.bincount(r[first], minlength=rows)
        np.maximum.at(top, r[first], runs)
    return distinct, top


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, SIZE) transformed statistics of the texts between the offsets."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    kind = CLASS[raw]
    row_of = np.repeat(np.arange(rows), sizes)
    counts = np.bincount(row_of * 8 + kind, minlength=rows * 8).reshape(rows, 8).astype(float)
    inside = kind != BLANK
    opens, closes = inside.copy(), inside.copy()
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    same_row = np.ones(max(0, len(raw) - 1), bool)
    same_row[edge - 1] = False
    opens[1:] &= ~(inside[:-1] & same_row)
    closes[:-1] &= ~(inside[1:] & same_row)
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    words = np.bincount(row_of[starts], minlength=rows).astype(float)
    fresh, top = distinct_and_top(spread_hash(raw, starts, stops), row_of[starts], rows)
    breaks = np.flatnonzero(raw == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_row = np.sort(np.concatenate([np.arange(rows), row_of[breaks]]), kind="stable")
    line_stops = np.append(line_starts[1:], len(raw))
    ends_line = np.zeros(len(line_starts), bool)
    ends_line[:-1] = line_row[1:] == line_row[:-1]
    line_stops = np.where(ends_line, line_stops - 1, offsets[1:][line_row])
    lines = np.bincount(line_row, minlength=rows).astype(float)
    fresh_lines, _ = distinct_and_top(spread_hash(raw, line_starts, line_stops), line_row, rows)
    ends = raw[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    marked = np.isin(CLASS[ends], (MARK, SYMBOL)) & (ends != ord(".")) & (ends != ord(","))
    same_marks = np.bincount(row_of[starts][marked], minlength=rows)
    share = lambda x, of: np.sqrt(x / np.maximum(1, of))
    seen = counts.sum(axis=1)
    return np.stack(
        [
            np.log1p(words),
            np.log1p((seen - counts[:, BLANK]) / np.maximum(1, words)),
            share(counts[:, UPPER], seen),
            share(counts[:, DIGIT], seen),
            share(counts[:, MARK], seen),
            share(counts[:, SYMBOL], seen),
            share(counts[:, BLANK], seen),
            share(counts[:, HIGH], seen),
            np.log1p(lines - 1) - np.log1p(words),
            share(fresh, words),
            share(top, words),
            share(fresh_lines, lines),
            share(same_marks, words),
        ],
        axis=1,
    )


def batch_statistics(batch: pa.RecordBatch) -> np.ndarray:
    raw, offsets = text_buffers(batch.column("body"))
    parts, at = [np.zeros((0, SIZE))], 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        parts.append(statistics(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
        at = to
    return np.concatenate(parts)


@dataclass
class Model:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log odds."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    determinants: list[float]
    odds: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.determinants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / SIZE + self.odds, -500, 500)))


def fitted(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Model:
    """From n, the sums and the sums of products of each class."""
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    if not n[0] or not n[1]:
        return Model([], [], [], 0.0, constant=0.5 if not n[0] + n[1] else float(n[1] > 0))
    means = [sums[k][1] / n[k] for k in (0, 1)]
    covariances = [sums[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / (n[0] + n[1])
    spread = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, determinants = [], []
    for c in covariances:
        shrunk = (1 - DIAGONAL) * ((1 - POOLED) * c + POOLED * pooled) + DIAGONAL * spread
        lower = np.linalg.cholesky(shrunk + 1e-9 * np.eye(SIZE))
        factors.append(np.linalg.inv(lower))
        determinants.append(2 * float(np.log(np.diag(lower)).sum()))
    return Model(means, factors, determinants, float(np.log(n[1] / n[0])) / SIZE)


def held_out(id_col: str, folds: int = FOLDS, out: int = HELD_OUT):
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % folds == out, F.lit(False))


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch_statistics(batch)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), SIZE).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), flat], ["doc", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on all labelled rows but the held-out ones."""
    known = labels.where(~held_out(id_col)).select(quoted(id_col).cast("long").alias("doc"), quoted(label_col).cast("int").alias("label")).where("doc IS NOT NULL AND label IN (0, 1)")
    texts = docs.where(~held_out(id_col)).select(quoted(id_col).cast("long").alias("doc"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    rows = texts.mapInArrow(measured, "doc long, x array<double>").join(known.distinct(), "doc")
    firsts = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(SIZE)]
    pairs = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(SIZE) for j in range(i + 1)]
    sums = {}
    for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *firsts, *pairs).collect():
        products = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(SIZE)] for i in range(SIZE)])
        sums[r.label] = (float(r.n), np.array([r[f"s{i}"] for i in range(SIZE)]), products)
    return fitted(sums)


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with ``score``; one scan without a shuffle."""
    names = [f"c{i}" for i in range(len(keep))]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(batch_statistics(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values, pa.float64())], [*names, "score"])

    rows = docs.select(*(quoted(c).alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    return rows.mapInArrow(scores, f"{kinds}score double").select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "score")


@query("op6_quality")
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")), keep=("doc_id",))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
