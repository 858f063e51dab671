"""Integer vectors from floating-point ones, for operators that need exact sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256


def integer_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column ``vector`` as floor(SCALE * x); rows with a null vector, or any null
    or non-finite component, go. A component beyond 32 bits raises ``ValueError``."""
    for batch in batches:
        vector = batch.column("vector")
        sizes = vector.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        values = vector.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
        good = np.ones(batch.num_rows, bool)
        good[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(values)]] = False
        good &= vector.is_valid().to_numpy(zero_copy_only=False)
        scaled = np.floor(SCALE * values[np.repeat(good, sizes)])
        if len(scaled) and np.abs(scaled).max() >= 2**31:
            raise ValueError("a component of 2^23 or more is beyond the integers used here")
        offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
        whole = pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled.astype(np.int32)))
        kept = batch.filter(pa.array(good))
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([whole if n == "vector" else kept.column(n) for n in names], names=names)


def quantised(rows: DataFrame, vector: str, others: dict[str, str]) -> DataFrame:
    """The columns of ``others`` (new name: given name; as longs) and ``vector`` as integers."""
    read = rows.select(*[F.col(f"`{given}`").cast("long").alias(name) for name, given in others.items()], F.col(f"`{vector}`").alias("vector"))
    return read.mapInArrow(integer_vectors, ", ".join([*[f"{name} long" for name in others], "vector array<int>"]))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix; short ones are filled up by zeros."""
    sizes = vectors.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out
