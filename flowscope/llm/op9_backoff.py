"""Stupid-backoff language-model scores of every document, from n-gram counts of all other documents.

S(w | history) is the share c(history w) / c(history) of the longest history for which both counts are positive, times
``ALPHA`` for each word of history given up; a single word has max(c, UNSEEN) / N. Counts are those of the whole corpus
less the document's own (``own`` counts would make every n-gram known). A document's score is the sum of log S over its
words, and that sum per word.

1. Documents are dealt to chunks by hash. A chunk's n-grams of each order are exploded and counted, and its distinct
   hashes are dealt to buckets of the count table, packed: an n-gram that a chunk holds a thousand times travels once.
2. Bucket by bucket the table is summed and joined to the n-grams of each chunk, whose counts go back to it.
3. A chunk joins the counts to its words' places, subtracts what each document holds itself, and sums per document.

Chunks and buckets follow the session's number of shuffle partitions, so that each stays small as the input grows. Words
are as in the decontamination operator and are told apart by 64-bit hashes.

Defined cases: a null or empty text has no words, score 0 and mean 0; rows that repeat an id are documents of their own;
a null id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import keyed_text, shuffle_parts, table, text_buffers
from flowscope.llm.op5_decontaminate import SLICE, grams, word_hashes
from flowscope.plans.registry import query

ORDER = 2
LONGER = 3
ALPHA = 0.4
UNSEEN = 0.5
CHUNKS_PER_PART = 2
U = np.uint64
PACKED = pa.schema([("size", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
PACKED_SQL = "size int, bucket int, chunk int, hashes binary, counts binary"
ANSWER = pa.schema([("size", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])
ANSWER_SQL = "size int, bucket int, chunk int, counts binary"
SCORE = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])
SCORE_SQL = "doc long, n_words long, n_backed_off long, log_score double, mean_log_score double"


def words_of(bodies: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the number of words of each."""
    words, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for part in bodies.chunks:
        raw, offsets = text_buffers(part)
        at = 0
        while at < len(part):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            w, n = word_hashes(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            words.append(w)
            counts.append(n)
            at = to
    return np.concatenate(words), np.concatenate(counts)


def grams_inside(words: np.ndarray, row_of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that do not cross rows, and where each ends."""
    hashes = words if size == 1 else grams(words, size)
    ends = np.arange(len(hashes)) + size - 1
    whole = row_of[: len(hashes)] == row_of[ends] if len(hashes) else np.zeros(0, bool)
    return hashes[whole], ends[whole]


def in_buckets(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts hashes by bucket and keeps them sorted inside, and where each bucket begins."""
    bucket = (distinct % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def exploded(chunk: pa.Table, order: int, buckets: int) -> pa.Table:
    """The distinct n-grams of a chunk, a packed row per order and bucket; size 0 is the number of words."""
    words, counts = words_of(chunk.column("body"))
    number = chunk.column("chunk")[0].as_py()
    row_of = np.repeat(np.arange(len(counts)), counts)
    rows = [(0, 0, number, b"", np.array([len(words)], np.int64).tobytes())]
    for size in range(1, order + 1):
        distinct, n = np.unique(grams_inside(words, row_of, size)[0], return_counts=True)
        at, starts = in_buckets(distinct, buckets)
        for b in range(buckets):
            part = at[starts[b] : starts[b + 1]]
            if len(part):
                rows.append((size, b, number, distinct[part].tobytes(), n[part].astype("<u4").tobytes()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED)


def answered(bucket: pa.Table) -> pa.Table:
    """Total counts of a bucket's n-grams, for each chunk in the order in which it asked."""
    size, counts = bucket.column("size")[0].as_py(), bucket.column("counts").to_pylist()
    if size == 0:
        total = sum(int(np.frombuffer(c, np.int64)[0]) for c in counts)
        out = [np.array([total], np.int64).tobytes()] * len(counts)
    else:
        asked = [np.frombuffer(h, U) for h in bucket.column("hashes").to_pylist()]
        distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, place, np.concatenate([np.frombuffer(c, "<u4") for c in counts]))
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        out = [totals[p].tobytes() for p in np.split(place, cuts)]
    columns = [bucket.column(n) for n in ("size", "bucket", "chunk")]
    return pa.Table.from_arrays([*columns, pa.array(out, pa.binary())], schema=ANSWER)


def others_counts(words: np.ndarray, row_of: np.ndarray, size: int, buckets: int, answers: dict[int, bytes]) -> np.ndarray:
    """For each word place the count, in all other documents, of the n-gram that ends there; -1 where none does."""
    hashes, ends = grams_inside(words, row_of, size)
    distinct, place = np.unique(hashes, return_inverse=True)
    at, starts = in_buckets(distinct, buckets)
    totals = np.zeros(len(distinct), np.int64)
    for b, blob in answers.items():
        totals[at[starts[b] : starts[b + 1]]] = np.frombuffer(blob, np.int64)
    _, pair, own = np.unique(row_of[ends] * max(1, len(distinct)) + place, return_inverse=True, return_counts=True)
    out = np.full(len(words), -1, np.int64)
    out[ends] = totals[place] - own[pair]
    return out


def log_scores(counts: list[np.ndarray], n_words: np.ndarray, row_of: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """log S of every word, and whether it gave up history. ``counts[n - 1]``: counts of the n-grams that end at a place."""
    order, places = len(counts), len(row_of)
    first = np.cumsum(n_words) - n_words
    reach = np.minimum(order, np.arange(places) - np.repeat(first, n_words) + 1)
    others = np.maximum(1, total - n_words)[row_of] if places else np.zeros(0)
    value = np.log(np.maximum(counts[0], UNSEEN) / others) + (reach - 1) * np.log(ALPHA)
    used = np.ones(places, np.int64)
    for size in range(2, order + 1):
        here = counts[size - 1]
        before = np.concatenate([[0], counts[size - 2][:-1]])[:places]
        known = (reach >= size) & (here > 0) & (before > 0)
        value[known] = np.log(here[known] / before[known]) + (reach[known] - size) * np.log(ALPHA)
        used[known] = size
    return value, used < reach


def scored(docs: pa.Table, answers: pa.Table, order: int, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return SCORE.empty_table()
    words, n_words = words_of(docs.column("body"))
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    given: dict[int, dict[int, bytes]] = {s: {} for s in range(order + 1)}
    for size, bucket, blob in zip(*(answers.column(c).to_pylist() for c in ("size", "bucket", "counts")), strict=True):
        given[size][bucket] = blob
    total = int(np.frombuffer(given[0][0], np.int64)[0])
    counts = [others_counts(words, row_of, s, buckets, given[s]) for s in range(1, order + 1)]
    value, gave_up = log_scores(counts, n_words, row_of, total)
    sums = np.bincount(row_of, value, len(n_words))
    backed = np.bincount(row_of, gave_up, len(n_words)).astype(np.int64)
    columns = [docs.column("doc").combine_chunks(), pa.array(n_words), pa.array(backed), pa.array(sums), pa.array(sums / np.maximum(1, n_words))]
    return pa.Table.from_arrays(columns, schema=SCORE)


def backoff_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document row: ``doc``, ``n_words``, ``n_backed_off``, ``log_score`` and ``mean_log_score``."""
    buckets = shuffle_parts(df.sparkSession)
    chunk = F.pmod(F.xxhash64("doc", F.length("body")), F.lit(CHUNKS_PER_PART * buckets)).cast("int")
    docs = keyed_text(df, id_col, text_col).withColumn("chunk", chunk)
    packed = docs.groupBy("chunk").applyInArrow(lambda t: exploded(t, order, buckets), PACKED_SQL)
    answers = packed.groupBy("size", "bucket").applyInArrow(answered, ANSWER_SQL)
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda d, a: scored(d, a, order, buckets), SCORE_SQL)


LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH split AS (SELECT doc_id, regexp_extract_all({LETTERS}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, unnest([NULL] || w[1 : len(w) - 1]) AS prev FROM split WHERE len(w) > 0),
own1 AS (SELECT doc_id, word, count(*) AS n FROM placed GROUP BY ALL),
all1 AS (SELECT word, sum(n) AS n FROM own1 GROUP BY word),
own2 AS (SELECT doc_id, prev, word, count(*) AS n FROM placed WHERE prev IS NOT NULL GROUP BY ALL),
all2 AS (SELECT prev, word, sum(n) AS n FROM own2 GROUP BY ALL),
total AS (SELECT count(*) AS n FROM placed),
sizes AS (SELECT doc_id, len(w) AS n FROM split),
c1 AS (SELECT doc_id, word, a.n - o.n AS c FROM own1 o JOIN all1 a USING (word)),
c2 AS (SELECT doc_id, prev, word, a.n - o.n AS c FROM own2 o JOIN all2 a USING (prev, word)),
seen AS (SELECT p.doc_id, p.i, w.c AS c_word, coalesce(b.c, 0) AS c_pair, coalesce(h.c, 0) AS c_prev, greatest(1, t.n - s.n) AS others
         FROM placed p CROSS JOIN total t JOIN sizes s ON s.doc_id = p.doc_id JOIN c1 w ON w.doc_id = p.doc_id AND w.word = p.word
         LEFT JOIN c2 b ON b.doc_id = p.doc_id AND b.prev = p.prev AND b.word = p.word LEFT JOIN c1 h ON h.doc_id = p.doc_id AND h.word = p.prev),
scores AS (SELECT doc_id, i > 0 AND NOT (c_pair > 0 AND c_prev > 0) AS gave_up,
           CASE WHEN c_pair > 0 AND c_prev > 0 THEN ln(c_pair / c_prev) ELSE ln(greatest(c_word, {UNSEEN}) / others) + CASE WHEN i > 0 THEN ln({ALPHA}) ELSE 0 END END AS s FROM seen),
sums AS (SELECT doc_id, count(*) AS n, sum(gave_up::INT) AS b, sum(s) AS s FROM scores GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(b, 0) AS BIGINT) AS n_backed_off,
       round(coalesce(s, 0), 4) AS log_score, round(coalesce(s / n, 0), 6) AS mean_log_score
FROM split d LEFT JOIN sums USING (doc_id)
"""


def rounded(out: DataFrame) -> DataFrame:
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


@query("op9_backoff", SQL)
def op9_backoff(spark, sf_dir):
    return rounded(backoff_scores(table(spark, sf_dir, "documents")))


@query("op9_backoff_order3")
def op9_backoff_order3(spark, sf_dir):
    return rounded(backoff_scores(table(spark, sf_dir, "documents"), order=LONGER))
