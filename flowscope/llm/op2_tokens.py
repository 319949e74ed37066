"""Token counts without token ids: pieces are counted once per distinct pre-token, and summed by frequency.

1. Pre-tokens are cut in the JVM by the vocabulary's pattern and counted per task, then over the corpus.
2. Each distinct pre-token is encoded once and only the number of its pieces is kept.
3. Pre-tokens that make up at least 1 / ``HOT_SHARE`` of all occurrences, of which there can be no more than
   ``HOT_SHARE``, are given to every task; they cover most of the text and are every hot key there is. The other
   (document, pre-token, frequency) rows are joined by a shuffle, and both parts are summed per document.

Strings of added tokens inside a text are tokens of their own, as is the library's default. Defined cases: a null or
empty text has no tokens; every row of a repeated id gets its own result; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.common import quoted, table
from flowscope.plans.registry import query
from flowscope.session import cut_lineage

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
HOT_SHARE = 1 << 20
# Longer pre-tokens are never hot, so that the broadcast is bounded in bytes too.
HOT_CHARS = 64
BATCH = 20_000
# Pre-tokens that a task looks at together.
SLICE = 1_000_000


def loaded(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def added_tokens(tokenizer) -> list[str]:
    """Strings of added tokens; only those that match as plain strings are supported."""
    if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space:
        raise ValueError("only byte-level vocabularies without a normalizer and without a prefix space are supported")
    found = list(tokenizer.get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word for t in found):
        raise ValueError("added tokens that strip or match whole words are not supported")
    return sorted((t.content for t in found), key=len, reverse=True)


def pre_tokens(body: Column, added: list[str]) -> Column:
    """All pre-tokens of a text without its added tokens, in order."""
    cut = lambda text: F.regexp_extract_all(text, F.lit("(?U)" + public_tokenizers.PATTERN), F.lit(0))
    if not added:
        return cut(body)
    between = F.flatten(F.transform(F.split(body, added_pattern(added), -1), cut))
    return F.when(body.rlike(added_pattern(added)), between).otherwise(cut(body))


def added_pattern(added: list[str]) -> str:
    return "|".join(re.escape(t) for t in added)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pc.value_counts(batch.column(0).flatten())
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["piece", "n"])


def encoded_lengths(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    tokenizer = loaded(text)
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            lengths = [len(e.ids) for e in tokenizer.encode_batch_fast(part.column("piece").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([part.column("piece"), part.column("n"), pa.array(lengths, pa.int64())], ["piece", "n", "tokens"])


HEAD = pa.struct([("doc", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64())])
ENTRY = pa.schema([("row", pa.int64()), ("piece", pa.string()), ("freq", pa.int32()), ("head", HEAD)])


def frequencies(batches: Iterator[pa.RecordBatch], hot: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Rows of (row, piece, freq), and one per row with its id, size and the tokens already counted as its ``head``."""
    for batch in batches:
        offsets = np.asarray(batch.column("words").offsets, np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
            yield from entries(batch.slice(at, to - at), hot)
            at = to


def entries(batch: pa.RecordBatch, hot: dict[str, int]) -> Iterator[pa.RecordBatch]:
    words = batch.column("words")
    coded = words.flatten().dictionary_encode()
    each = np.array([hot.get(p, -1) for p in coded.dictionary.to_pylist()] or [0], np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(np.asarray(words.offsets, np.int64))
    place = np.repeat(np.arange(batch.num_rows), lengths)
    tokens = each[codes] if len(codes) else np.zeros(0, np.int64)
    rows = batch.column("row").to_numpy(zero_copy_only=False)
    pairs, freq = np.unique(place[tokens < 0] * len(each) + codes[tokens < 0], return_counts=True)
    if len(pairs):
        pieces = coded.dictionary.take(pa.array(pairs % len(each)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[pairs // len(each)]), pieces, pa.array(freq.astype(np.int32)), pa.nulls(len(pairs), HEAD)], schema=ENTRY)
    known = np.bincount(place, np.maximum(tokens, 0), batch.num_rows).astype(np.int64) + batch.column("specials").to_numpy(zero_copy_only=False)
    head = pa.StructArray.from_arrays([batch.column("doc"), batch.column("n_bytes"), pa.array(known)], fields=list(HEAD))
    # No pre-token mixes a control character with digits: this key spreads the heads and joins nothing.
    keys = pa.array([f"\x00{row}" for row in rows.tolist()], pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(rows), keys, pa.array(np.zeros(len(rows), np.int32)), head], schema=ENTRY)


def piece_table(words: DataFrame, vocabulary: str) -> DataFrame:
    """Every distinct pre-token of the corpus with its occurrences ``n`` and its number of pieces ``tokens``."""
    counts = words.select("words").mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return cut_lineage(counts.mapInArrow(lambda it: encoded_lengths(it, vocabulary), "piece string, n long, tokens long"))


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc``, ``n_bytes``, ``n_tokens``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    added = added_tokens(loaded(vocabulary))
    body = F.coalesce(quoted(text_col), F.lit(""))
    words = df.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).cast("long").alias("doc"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("body"))
    specials = (F.size(F.split("body", added_pattern(added), -1)) - 1).cast("long") if added else F.lit(0).cast("long")
    cut = words.select("row", "doc", "n_bytes", specials.alias("specials"), pre_tokens(F.col("body"), added).alias("words"))
    pieces = piece_table(cut, vocabulary)
    total = pieces.agg(F.sum("n").alias("n")).first().n or 0
    frequent = pieces.where((F.col("n") * HOT_SHARE >= total) & (F.length("piece") <= HOT_CHARS))
    hot = df.sparkSession.sparkContext.broadcast({r.piece: r.tokens for r in frequent.select("piece", "tokens").toLocalIterator()})
    freq = cut.mapInArrow(lambda it: frequencies(it, hot.value), "row long, piece string, freq int, head struct<doc:long,n_bytes:long,known:long>")
    found = freq.join(pieces.select("piece", "tokens"), "piece", "left")
    n_tokens = F.sum(F.coalesce("head.known", F.lit(0)) + F.col("freq") * F.coalesce("tokens", F.lit(0)))
    sums = found.groupBy("row").agg(F.max("head.doc").alias("doc"), F.max("head.n_bytes").alias("n_bytes"), n_tokens.alias("n_tokens"))
    return sums.select("doc", "n_bytes", "n_tokens")


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
