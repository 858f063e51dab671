"""Packing along a space-filling curve.

Each document's pre-tokens are hashed into a vector, which a fixed random matrix
takes to three dimensions; the place of that point on a Hilbert curve orders the
documents, so that like texts share sequences. The curve is cut into ranges by
sampled splitters (ties go by identifier, so copies, which share a place, spread),
each range is sorted, and a running sum of lengths, offset by what all earlier
ranges hold, gives every token its sequence. Only the last sequence has padding.

The ids of a text come from the tokenizer, which is asked once for each
pre-token that a worker meets and remembers.

Defined results: a null text counts as empty and gives the end id alone; null
identifiers sort last; repeated rows are documents of their own; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.ids import ids_of
from verity.llm.pretokens import blocks, scramble
from verity.llm.shared import few_rows, partitions, written

LENGTH = 4096
END_ID = 2
FEATURES, DIMENSIONS, BITS = 256, 3, 16
SAMPLE = 40  # sampled documents for each range


def projected(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Signed hashed counts of each document's pre-tokens (n x FEATURES)."""
    mixed = scramble(hashes ^ np.uint64(0x5EED))
    feature = (mixed >> np.uint64(56)).astype(np.int64)  # 256 features
    sign = np.where(mixed & np.uint64(1), 1.0, -1.0)
    return np.bincount(owner * FEATURES + feature, sign, n * FEATURES).reshape(n, FEATURES)


def hilbert_keys(vectors: np.ndarray) -> np.ndarray:
    """The place of each vector's projection on a Hilbert curve through a cube
    of 2^BITS cells a side (Gray-code walk, all points at once)."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    matrix = np.random.default_rng(7).standard_normal((FEATURES, DIMENSIONS))
    points = np.tanh((vectors / np.where(norm > 0, norm, 1)) @ matrix) * 0.5 + 0.5
    x = np.minimum((points * 2**BITS).astype(np.int64), 2**BITS - 1).T.copy()
    bit = 1 << (BITS - 1)
    while bit > 1:
        low = bit - 1
        for i in range(DIMENSIONS):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, DIMENSIONS):
        x[i] ^= x[i - 1]
    parity = np.zeros_like(x[0])
    bit = 1 << (BITS - 1)
    while bit > 1:
        parity = np.where(x[DIMENSIONS - 1] & bit, parity ^ (bit - 1), parity)
        bit >>= 1
    x ^= parity
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(DIMENSIONS):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = ids_of(path)
        kind = np.dtype("<u2") if len(make.encoder.ends) <= 1 << 16 else np.dtype("<u4")
        end = np.array([end_id], kind).tobytes()

        def batch_of(rows) -> pa.RecordBatch:
            keys = hilbert_keys(np.array([v for *_, v in rows]))
            return pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in rows], pa.int64()), pa.array(keys, pa.int64()),
                pa.array([len(b) // kind.itemsize for _, b, _ in rows], pa.int64()), pa.array([b for _, b, _ in rows], pa.binary())],
                names=["doc_id", "key", "doc_tokens", "ids"])

        for batch in few_rows(batches):
            ids, rows, held = batch.column("doc_id").to_pylist(), [], 0
            open_at, open_bytes, open_vector = -1, [], np.zeros(FEATURES)
            for numbers, parts in blocks(batch.column("text").to_pylist()):
                found, sizes, hashes, owner = make(parts)
                coded, vectors = found.astype(kind), projected(hashes, owner, len(parts))
                for number, piece, vector in zip(numbers, np.split(coded, np.cumsum(sizes)[:-1]), vectors):
                    if number != open_at:
                        if open_at >= 0:
                            rows.append((ids[open_at], b"".join(open_bytes) + end, open_vector))
                        open_at, open_bytes, open_vector = number, [], np.zeros(FEATURES)
                    open_bytes.append(piece.tobytes())
                    open_vector = open_vector + vector
                    held += len(open_bytes[-1])
                if held > 4_000_000 and rows:
                    yield batch_of(rows)
                    rows, held = [], 0
            if open_at >= 0:
                rows.append((ids[open_at], b"".join(open_bytes) + end, open_vector))
            if rows:
                yield batch_of(rows)
    return run


def _cuts(tokenised: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Splitters (key, identifier) between ranges of about equal length, from a
    sample of at most about ``SAMPLE`` documents a range."""
    rows = tokenised.count()
    sample = tokenised.select("key", _id_last(), "doc_tokens").sample(min(1.0, SAMPLE * ranges / max(rows, 1)), 17).collect()
    sample.sort()
    total, cuts, sums = sum(r[2] for r in sample), [], 0
    for key, number, size in sample:
        sums += size
        if sums * ranges > total * (len(cuts) + 1) and len(cuts) < ranges - 1:
            cuts.append((key, number))
    return cuts


def _id_last():
    return F.coalesce("doc_id", F.lit(2**63 - 1)).alias("last_id")


def _pieces(base: dict[int, int], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in few_rows(batches):
            out: list[tuple] = []
            for part, doc_id, size, coded in zip(*(batch.column(c) for c in ("range", "doc_id", "doc_tokens", "ids"))):
                part, doc_id, size, coded = part.as_py(), doc_id.as_py(), size.as_py(), coded.as_py()
                if part != current:
                    current, at = part, base[part]
                ids, start = np.frombuffer(coded, f"<u{len(coded) // size}").astype("<u4"), 0
                while start < size:
                    n = min(size - start, length - at % length)
                    out.append((doc_id, start, n, zlib.crc32(ids[start: start + n].tobytes()), size, at // length, at % length))
                    start, at = start + n, at + n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7,
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def packed(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``."""
    spark = docs.sparkSession
    made = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        _tokenised(tokenizer, end_id), "doc_id long, key long, doc_tokens long, ids binary")
    tokenised = written(made, "ids")
    n = partitions(spark)
    cuts = _cuts(tokenised, 4 * n)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(key.tolist(), number.tolist())], dtype="int32")

    dealt = tokenised.withColumn("range", range_of("key", _id_last()))
    totals = {r[0]: r[1] for r in dealt.groupBy("range").agg(F.sum("doc_tokens")).collect()}  # at most 4 n rows
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    ordered = dealt.repartition(n, "range").sortWithinPartitions("range", "key", F.col("doc_id").asc_nulls_last(), "doc_tokens", "ids")
    return ordered.mapInArrow(_pieces(base, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
