"""Toxicity by compression distance: how much shorter a window gets with a dictionary of toxic text than of ordinary text.

1. A bounded sample of labelled rows (``SAMPLE`` of each class, those with the smallest hash of the id) gives the segments,
   up to 12 bytes within a word, that are frequent in toxic rows and rare in ordinary ones, and the frequent words of
   ordinary rows. They are the contents of two zstandard dictionaries.
2. A window is one word, lower-cased (ASCII), followed by a tail that both dictionaries hold, since the library seeks no
   match in the last bytes of its input. Its two compressed lengths make a cell. The same sample gives the log ratio of
   each cell's share in toxic and ordinary rows; cells above ``STRONG`` are the calibrated threshold.
3. A document's evidence is its share of windows in strong cells, ``PRIOR`` windows more taken as ordinary. A logistic curve, fitted to the sample with equal
   weight for both classes and moved to the best cut between them, turns evidence into the score.

Scoring is one scan without a shuffle; lengths of repeated windows are kept by the task in a table of bounded size.

Defined cases: a null or empty text has no windows and evidence 0; without labelled rows of both classes the score is the
share of toxic rows among the labelled (0 without any); every row of a repeated id gets its own result, a null id is not
held out; null labels teach nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import quoted, table
from flowscope.plans.registry import query

# Rows of each class to learn from, at most: ordinary text takes more to tell its rare words from toxic ones.
SAMPLE = {1: 1_000, 0: 4_000}
# A sampled row gives at most so many bytes of its words, taken evenly from the whole text.
SAMPLE_BYTES = 60_000
SIZE = 8_192
LEVEL = 3
SEGMENTS = (4, 5, 6, 7, 8, 10, 12)
LONGEST = 40
LEAST_ROWS, LEAST_LOG_RATIO = 4, 3.0
TAIL = b"abcdefghijklmnopqrstuvwxyz0123456789"
HEIGHT, WIDTH, SHIFT = 48, 32, 12
STRONG = 2.0
# Windows that every document is taken to have besides its own, none of them strong.
PRIOR = 20
SMOOTH = 1e-4
KNOWN = 200_000
THRESHOLD = 0.5
# Weight of an ordinary row taken for toxic against a toxic row missed.
ALARM = 3.0
FOLDS, HELD_OUT = 5, 0


def windows_of(text: bytes) -> list[bytes]:
    return [b" " + w + b" " for w in text.lower().split()]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    strong: list[int]
    slope: float
    offset: float
    constant: float | None = None

    @cached_property
    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def made(content: bytes) -> zstandard.ZstdCompressor:
            words = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

        return made(self.toxic), made(self.ordinary)

    @cached_property
    def known(self) -> dict[bytes, int]:
        return {}

    def cell(self, window: bytes) -> int:
        """Cell of the two compressed lengths of a window."""
        found = self.known.get(window)
        if found is None:
            toxic, ordinary = (len(c.compress(window + TAIL)) for c in self.compressors)
            found = min(toxic, HEIGHT - 1) * WIDTH + min(max(ordinary - toxic + SHIFT, 0), WIDTH - 1)
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[window] = found
        return found

    def cells(self, text: bytes) -> np.ndarray:
        return np.bincount([self.cell(w) for w in windows_of(text)], minlength=HEIGHT * WIDTH)

    def evidence(self, text: bytes) -> float:
        windows = windows_of(text)
        strong = set(self.strong)
        return sum(self.cell(w) in strong for w in windows) / (PRIOR + len(windows))

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.evidence(text) + self.offset, -500, 500))))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("compressors", "known")}


def segments(text: bytes) -> set[bytes]:
    found = set()
    for window in set(windows_of(text)):
        window = window[:LONGEST]
        for n in SEGMENTS:
            found.update(window[i : i + n] for i in range(len(window) - n + 1))
    return found


def toxic_content(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Segments of at least LEAST_ROWS toxic rows with a high log ratio, the most covering first, none inside another."""
    rows = Counter(s for t in toxic for s in segments(t))
    rows = {s: n for s, n in rows.items() if n >= LEAST_ROWS}
    other: Counter = Counter()
    for t in ordinary:
        other.update(s for s in segments(t) if s in rows)
    ratio = lambda s: np.log((rows[s] + 0.5) / (len(toxic) + 1)) - np.log((other[s] + 0.5) / (len(ordinary) + 1))
    content = b""
    for s in sorted((s for s in rows if ratio(s) > LEAST_LOG_RATIO), key=lambda s: (-rows[s] * len(s), s)):
        if s not in content:
            content += s
        if len(content) >= SIZE // 4:
            break
    return content


def ordinary_content(ordinary: list[bytes]) -> bytes:
    rows = Counter(w[:LONGEST] for t in ordinary for w in set(windows_of(t)))
    return b"".join(w for w, _ in sorted(rows.items(), key=lambda r: (r[1], r[0])))[-SIZE:]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with equal class weights and a small ridge."""
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 0.01 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fitted(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    if not toxic or not ordinary:
        return Model(b"", b"", [], 0.0, 0.0, constant=1.0 if toxic else 0.0)
    model = Model(toxic_content(toxic, ordinary), ordinary_content(ordinary), [], 0.0, 0.0)
    cells = np.array([model.cells(t) for t in toxic + ordinary], np.float32)
    n = cells.sum(axis=1)
    shares = cells / np.maximum(1, n)[:, None]
    y = np.array([1] * len(toxic) + [0] * len(ordinary))
    ratio = np.log((shares[y == 1].mean(axis=0) + SMOOTH) / (shares[y == 0].mean(axis=0) + SMOOTH))
    model.strong = [int(i) for i in np.flatnonzero(ratio > STRONG)]
    evidence = cells[:, model.strong].sum(axis=1) / (PRIOR + n)
    model.slope, model.offset = logistic(evidence, y)
    if model.slope > 0:
        model.offset = -model.slope * best_cut(evidence, y)
    return model


def best_cut(evidence: np.ndarray, y: np.ndarray) -> float:
    """The cut with the least sum of the share of toxic rows missed and ``ALARM`` times the share of ordinary ones hit."""
    steps = np.unique(evidence)
    cuts = np.concatenate([[steps[0] / 2 - 1e-9], (steps[1:] + steps[:-1]) / 2, [steps[-1] + 1e-9]])
    missed = np.searchsorted(np.sort(evidence[y == 1]), cuts) / (y == 1).sum()
    hit = 1 - np.searchsorted(np.sort(evidence[y == 0]), cuts) / (y == 0).sum()
    return float(cuts[np.argmin(missed + ALARM * hit)])


def held_out(id_col: str, folds: int, out: int):
    return F.coalesce(F.crc32(quoted(id_col).cast("string").cast("binary")) % folds == out, F.lit(False))


def sampled_text(text: str) -> bytes:
    raw = text.encode()
    if len(raw) <= SAMPLE_BYTES:
        return raw
    words = raw.split()
    return b" ".join(words[:: -(-len(raw) // SAMPLE_BYTES)])[:SAMPLE_BYTES]


def samples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sampled_text(t.as_py()) for t in batch.column(0)], pa.binary())], ["part"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most SAMPLE rows of each class; held-out rows are never read."""
    known = labels.where(~held_out(id_col, FOLDS, HELD_OUT)).select(quoted(id_col).cast("long").alias("doc"), quoted(label_col).cast("int").alias("label")).where("doc IS NOT NULL")
    texts = docs.select(quoted(id_col).cast("long").alias("doc"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    found = []
    for label in (1, 0):
        chosen = known.where(F.col("label") == label).distinct().orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE[label])
        rows = texts.join(F.broadcast(chosen.select("doc")), "doc").select("body").mapInArrow(samples_of, "part binary")
        found.append(sorted(bytes(r.part) for r in rows.toLocalIterator()))
    return fitted(*found)


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns with ``score``; one scan."""
    names = [f"c{i}" for i in range(len(keep))]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.score(t.as_buffer().to_pybytes()) for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values, pa.float64())], [*names, "score"])

    rows = docs.select(*(quoted(c).alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    return rows.mapInArrow(scores, f"{kinds}score double").select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "score")


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")), keep=("doc_id",))
    return out.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
