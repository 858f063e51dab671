"""Token counts of whole texts, without making their ids.

1. Every task counts the distinct pre-tokens of its texts; the counts are
   summed over the corpus, and each distinct pre-token is given to the
   tokenizer once, for the number of its pieces.
2. Each document's pre-token frequencies are joined to those numbers and summed.

Pre-tokens that make up at least one in ``COMMON`` of all are at most
``COMMON`` many, whatever the corpus; their numbers travel to the tasks as one
broadcast of that bounded size, and most of a document is summed where it is
read. The rest, by construction none of them frequent, is joined by a shuffle on
a 64-bit hash of the pre-token (with d distinct pre-tokens, two share one with a
chance of d^2 / 2^65).

Defined results: a null text counts as empty and has no tokens; null or repeated
identifiers are told apart by a 128-bit hash of their texts, and rows that repeat
both come back as often as they were given; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.pretokens import Encoder, PreTokens, blocks, word_at
from verity.llm.shared import few_rows, written

COMMON = 1_000_000
LIMIT = 2048
FLUSH = 150_000


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PreTokens(path)
        counts: dict[int, int] = {}
        words: dict[int, str] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array((words[h] for h in counts), pa.string()),
                                              pa.array(counts.values(), pa.int64())], names=["h", "word", "n"])
            counts.clear()
            words.clear()
            return out

        for batch in few_rows(batches):
            for _, parts in blocks(batch.column(0).to_pylist()):
                units, starts, ends, _, hashes = tokens.split(parts)
                found, first, times = np.unique(_signed(hashes), return_index=True, return_counts=True)
                for h, i, n in zip(found.tolist(), first.tolist(), times.tolist()):
                    if h in counts:
                        counts[h] += n
                    else:
                        counts[h] = n
                        words[h] = word_at(units, starts[i], ends[i])
                if len(counts) > FLUSH:
                    yield flushed()
        yield flushed()
    return run


def _count_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            pieces = encoder.sizes(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(pieces, pa.int64()), batch.column("n")], names=["h", "pieces", "n"])
    return run


def _frequencies(path: str, common):
    """Per document one row with the pieces of its common pre-tokens, and one
    row for each other pre-token with its frequency in the document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PreTokens(path)
        known, pieces = common.value
        for batch in few_rows(batches):
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = [t.encode("utf-8", "surrogatepass") for t in texts]
            marks = [hashlib.blake2b(c, digest_size=16).digest() for c in coded]
            summed = np.zeros(len(ids), np.int64)
            for numbers, parts in blocks(texts):
                _, _, _, owner, hashes = tokens.split(parts)
                found, which = np.unique(_signed(hashes), return_inverse=True)
                at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                is_known = known[at] == found if len(known) else np.zeros(len(found), bool)
                size = np.where(is_known, pieces[at] if len(known) else 0, 0)
                docs = np.array(numbers, np.int64)[owner]
                np.add.at(summed, docs, size[which])
                rare = ~is_known[which]
                pairs, times = np.unique(np.stack([docs[rare], which[rare]]), axis=1, return_counts=True) if rare.any() else (np.zeros((2, 0), int), np.zeros(0, int))
                if len(times):
                    yield _rows([ids[i] for i in pairs[0]], [marks[i] for i in pairs[0]], found[pairs[1]], times)
            yield _rows(ids, marks, None, summed, [len(c) for c in coded])
    return run


def _rows(ids, marks, hashes, numbers, sizes=None) -> pa.RecordBatch:
    none = [None] * len(ids)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(none if hashes is None else hashes, pa.int64()),
        pa.array(numbers, pa.int64()), pa.array(none if sizes is None else sizes, pa.int64())], names=["doc_id", "mark", "h", "n", "n_bytes"])


def pretoken_pieces(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Each distinct pre-token's hash ``h``, number of ``pieces`` and occurrences ``n``."""
    counted = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_count_words(tokenizer), "h long, word string, n long")
    distinct = counted.groupBy("h").agg(F.min("word").alias("word"), F.sum("n").alias("n"))
    return written(distinct.mapInArrow(_count_pieces(tokenizer), "h long, pieces long, n long"), "pieces")


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``."""
    spark = docs.sparkSession
    pieces = pretoken_pieces(docs, tokenizer, text)
    total = pieces.agg(F.sum("n")).first()[0] or 0
    common = pieces.where(F.col("n") * COMMON >= total).select("h", "pieces").toArrow()  # at most COMMON rows
    h, n = (common.column(c).to_numpy() for c in ("h", "pieces"))
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((h[order], n[order]))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        _frequencies(tokenizer, shared), "doc_id long, mark binary, h long, n long, n_bytes long")
    # One pass over the texts feeds both. The rows of the documents themselves have
    # a null hash and would meet in one partition of the join: they are dealt by number,
    # with a flag by which they meet no pre-token.
    keyed = rows.withColumn("own", F.col("h").isNull()).withColumn("h", F.coalesce("h", F.monotonically_increasing_id()))
    joined = keyed.join(pieces.select("h", "pieces", F.lit(False).alias("own")), ["h", "own"], "left")
    tokens = F.sum(F.when(F.col("own"), F.col("n")).otherwise(F.col("n") * F.col("pieces")))
    summed = joined.groupBy("doc_id", "mark").agg(F.max("n_bytes").alias("n_bytes"), tokens.alias("tokens"),
                                                  F.count(F.when(F.col("own"), 1)).alias("times"))
    out = summed.withColumn("n_tokens", F.expr("tokens div times")).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
