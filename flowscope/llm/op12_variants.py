"""Spelling variants: words one edit apart, found by composing the vocabulary's acceptor with a one-edit transducer.

1. Words are counted by document in one scan, combined in the task, then summed.
2. An edit lies in one window of the longer word; outside of it both words agree. So each word goes to the windows of its
   own length and of the next one, first one half of the word and the other. Words with the same rest are one partition:
   reading the rest leads the acceptor to one state, at which the composition starts.
3. Windows with more than ``GROUP`` words are halved, in Spark, until none is left (a window of one place holds no more
   words than the alphabet has letters), so that a prefix that a third of all words share is no large task.
4. A task builds the minimised acceptors of a partition's longer and shorter words, and follows their composition with
   the transducer: pairs of states before the edit, the states that agree after it. Each pair is met once: a
   replacement lies in one window, and of equal letters in a row the first counts as the one left out.
5. What a word meets in a task is summed there (its near words, the best of them); chains of forms double per round.

Defined cases: a null text has no words; without an id nothing is garbled; rows that repeat an id count each; a word as
long as its text is a word; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import keyed_text, table
from flowscope.plans.registry import query
from flowscope.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT = 7, 2
RATIO = 10
GARBLED = 31
GROUP = 4096
# Different words that a task holds before it hands their counts on.
HELD = 200_000

State = dict[str, dict]


def counts_of(batches: Iterator[pa.RecordBatch], least_chars: int, garbled: int | None) -> Iterator[pa.RecordBatch]:
    """Words and how often the task has met them; with ``garbled`` runs whose hash it divides lose a letter."""
    held: Counter[str] = Counter()

    def packed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            runs = [r for r in RUN.findall(text.as_buffer().to_pybytes().lower().decode()) if len(r) >= least_chars]
            if garbled and doc is not None:
                start = zlib.crc32(b"%d:" % doc)
                for i, run in enumerate(runs):
                    h = zlib.crc32(run.encode(), start)
                    if h % garbled == 0:
                        at = h % len(run)
                        runs[i] = run[:at] + run[at + 1 :]
                runs = [r for r in runs if len(r) >= least_chars]
            held.update(runs)
            if len(held) >= HELD:
                yield packed()
    if held:
        yield packed()


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, garbled: int | None = None) -> DataFrame:
    """``word`` and ``n`` of all words of at least so many code points and occurrences."""
    met = keyed_text(df, id_col, text_col).mapInArrow(lambda it: counts_of(it, least_chars, garbled), "word string, n long")
    return met.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def windowed(word: Column, size: Column, a: Column, b: Column) -> list[Column]:
    """The window [a, b) of a word that stands for one of ``size`` letters: what is before, inside and behind."""
    behind = size - b
    inside = F.length(word) - a - behind
    return [F.substring(word, F.lit(1), a).alias("head"), F.substring(word, a + 1, inside).alias("inner"), F.substring(word, a + inside + 1, behind).alias("tail")]


def in_windows(words: DataFrame, windows: Column) -> DataFrame:
    """``words`` (``word``, ``n``, ``size``) in each of the windows, structs of ``a`` and ``b``."""
    rows = words.select("word", "n", "size", F.explode(windows).alias("w")).select("word", "n", "size", "w.a", "w.b")
    return rows.select("*", *windowed(F.col("word"), F.col("size"), F.col("a"), F.col("b")))


def cut_in_two(a: Column, b: Column) -> Column:
    middle = F.floor((a + b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b")))


KEY = ("size", "a", "b", "head", "tail")


def partitions(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Words in windows, none with more than ``group`` words of the same rest (unless it has one place)."""
    own = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    left = in_windows(own, cut_in_two(F.lit(0), F.col("size")))
    done = None
    while True:
        left = left.withColumn("key", F.xxhash64(*KEY))
        large = cut_lineage(left.where("b - a > 1").groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > group).select("key"))
        if not large.limit(1).count():
            return left if done is None else done.unionByName(left)
        small = left.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        # A window of one place stays as it is, though its hash may be that of a large group.
        cut = F.when(F.col("b") - F.col("a") > 1, cut_in_two(F.col("a"), F.col("b"))).otherwise(F.array(F.struct("a", "b")))
        left = cut_lineage(in_windows(left.join(large, "key", "left_semi"), cut))


def acceptor(words: list[str]) -> State:
    """The start of the smallest automaton that accepts these words, all of one length, in order."""
    known: dict[tuple, State] = {}
    open_states: list[State] = [{}]
    before = ""

    def close(depth: int) -> None:
        while len(open_states) > depth + 1:
            state = open_states.pop()
            same = known.setdefault(tuple((c, id(s)) for c, s in state.items()), state)
            open_states[-1][before[len(open_states) - 1]] = same

    for word in words:
        shared = len(commonprefix([before, word]))
        close(shared)
        for letter in word[shared:]:
            open_states[-1][letter] = {}
            open_states.append(open_states[-1][letter])
        before = word
    close(0)
    return open_states[0]


def agreeing(ways: list[tuple[str, State]]) -> Iterator[tuple[list[str], str]]:
    """Letters whose states accept the same rest, with the rest, where two or more do."""
    stack = [(ways, "")]
    while stack:
        now, rest = stack.pop()
        if not now[0][1]:
            yield [letter for letter, _ in now], rest
            continue
        following: dict[str, list[tuple[str, State]]] = {}
        for letter, state in now:
            for c, s in state.items():
                following.setdefault(c, []).append((letter, s))
        stack += [(some, rest + c) for c, some in following.items() if len(some) > 1]


def replaced(start: State) -> Iterator[list[str]]:
    """Sets of accepted words that differ in one place."""
    stack = [(start, "")]
    while stack:
        state, read = stack.pop()
        if len(state) > 1:
            for letters, rest in agreeing(list(state.items())):
                yield [read + c + rest for c in letters]
        stack += [(s, read + c) for c, s in state.items()]


def both_accept(a: State, b: State) -> Iterator[str]:
    stack = [(a, b, "")]
    while stack:
        a, b, read = stack.pop()
        if not a:
            yield read
        else:
            stack += [(s, b[c], read + c) for c, s in a.items() if c in b]


def left_out(longer: State, shorter: State, letter_before: str) -> Iterator[tuple[str, str]]:
    """Pairs of a word of ``longer`` and one of ``shorter`` that lacks one of its letters, the first of equal ones."""
    stack = [(longer, shorter, "")]
    while stack:
        a, b, read = stack.pop()
        last = read[-1:] or letter_before
        for c, s in a.items():
            if c != last:
                for rest in both_accept(s, b):
                    yield read + c + rest, read + rest
        stack += [(s, b[c], read + c) for c, s in a.items() if c in b]


def met_in(head: str, tail: str, size: int, inner: dict[str, int]) -> dict[str, list]:
    """Per word of a partition: how many of it are near, and the count and the name of the best."""
    long_size = size - len(head) - len(tail)
    longer = sorted(w for w in inner if len(w) == long_size)
    shorter = sorted(w for w in inner if len(w) < long_size)
    met: dict[str, list] = {}
    if not longer or len(inner) < 2:
        return met

    def meet(word: str, near: int, other: str) -> None:
        best = (-inner[other], head + other + tail)
        now = met.setdefault(word, [0, best])
        now[0] += near
        now[1] = min(now[1], best)

    # What all words share at the front is no part of the search, but for its last letters where they are equal: one of
    # those might be the one left out.
    front = commonprefix([longer[0], longer[-1], *shorter[:1], *shorter[-1:]])
    front = front.rstrip(front[-1:])
    start = acceptor([w[len(front) :] for w in longer])
    if len(longer) > 1:
        for words in replaced(start):
            # All of them are of one length, so that what is behind does not change their order.
            order = sorted((front + w for w in words), key=lambda w: (-inner[w], w))
            for i, word in enumerate(order):
                meet(word, len(order) - 1, order[1 if i == 0 else 0])
    if shorter:
        for word, near in left_out(start, acceptor([w[len(front) :] for w in shorter]), (head + front)[-1:]):
            meet(front + word, 1, front + near)
            meet(front + near, 1, front + word)
    return {w: [near, *best] for w, (near, best) in met.items()}


MET = pa.schema([("word", pa.string()), ("near", pa.int64()), ("less", pa.int64()), ("best", pa.string())])


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions come whole and one after the other (sorted)."""
    now, inner = None, {}

    def done() -> list[tuple]:
        if len(inner) < 2:
            return []
        size, _, _, head, tail = now
        return [(head + w + tail, *values) for w, values in met_in(head, tail, size, inner).items()]

    for batch in batches:
        out = []
        keys = zip(*(batch.column(c).to_pylist() for c in KEY), strict=True)
        for key, word, n in zip(keys, batch.column("inner").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if key != now:
                out += done()
                now, inner = key, {}
            inner[word] = n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), MET, strict=True)], schema=MET)
    out = done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), MET, strict=True)], schema=MET)


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Of all words (``word``, ``n``) with near ones: ``near``, their number, and ``best``, a struct of ``less`` (minus its count) and ``best``."""
    dealt = partitions(words, group).select(*KEY, "inner", "n", "key").repartition("key").sortWithinPartitions("key", *KEY)
    met = dealt.drop("key").mapInArrow(meetings, "word string, near long, less long, best string")
    return met.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct("less", "best")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of all words that have a ``form``; a form is more frequent than its word, so chains end."""
    ends = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        above = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = cut_lineage(ends.join(above, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not ends.where("moved").limit(1).count():
            return ends.select("word", "root")
        ends = ends.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """One row per word (``word``, ``n``): its ``form``, ``root``, ``n_near`` and ``form_n``."""
    words = cut_lineage(words.select("word", "n"))
    near = words.join(near_words(words, group), "word", "left")
    better = -F.col("best.less") >= ratio * F.col("n")
    found = cut_lineage(near.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(better, F.col("best.best")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n")))
    out = found.join(roots(found.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


RUN_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')"
BYTES_SQL = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))"
CRC_SQL = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {BYTES_SQL}), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"
SQL = f"""
WITH RECURSIVE met AS (SELECT doc_id, unnest({RUN_SQL}) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM met WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
hashed AS (SELECT run, n, {CRC_SQL} AS h FROM runs),
garbled AS (SELECT n, CASE WHEN h % {GARBLED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM garbled WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
lacking AS (SELECT DISTINCT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM lacking a JOIN lacking b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM lacking a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM lacking a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS best_n FROM pairs GROUP BY word),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * w.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, root, further) AS (
  SELECT word, word, form FROM found
  UNION ALL SELECT c.word, c.further, f.form FROM chain c JOIN found f ON f.word = c.further)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON c.word = f.word AND c.further IS NULL
"""


@query("op12_variants", SQL)
def op12_variants(spark, sf_dir):
    return variants(vocabulary(table(spark, sf_dir, "documents"), garbled=GARBLED))
