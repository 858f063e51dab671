"""Vector codes by product quantisation, nearest entries by slice-and-intersect masks.

A vector is cut into ``PARTS`` equal parts, each coded by the nearest of the 64 entries
of its position's codebook. For each dimension the entries' coordinates are
sorted once, and before each place in that order stands a 64-bit mask of the entries
met so far. A part's distance to the best of the entries next to it on each axis
is its initial radius: on each axis the entries within that radius are a range of the
sorted coordinates, so a mask, the difference of the masks at the range's two ends. The
dimensions' masks ANDed leave the entries of a box that holds the nearest
one and all its ties; they are compared exactly, lowest index first.

Codebooks start from the parts of the smallest identifiers' vectors and are refined by
``ROUNDS`` rounds of assigning and averaging. A round sends at most PARTS x 64 sums a
task through the shuffle, and as many in all to the driver.

Defined results: rows with a null vector, or a null or non-finite component, go; a
shorter vector is filled up by zeros to the longest one, and that to a multiple of
``PARTS``; null identifiers come last, ties of identifiers go by the vector's numbers; with
fewer rows than entries there are fewer entries; null labels share one sum; repeated
rows are coded each; an empty table gives an empty table; other columns are not read.
Squared distances that could leave 62 bits raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.shared import written
from verity.llm.vectors import matrix, quantised

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SALTS = 32  # partitions over which the rows of one label are dealt
_ONE = np.uint64(1)


class Nearest:
    """The nearest entry of one codebook (entries x dimensions) for many parts."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(entries.T, self.order, axis=1)
        bits = _ONE << self.order.astype(np.uint64)
        self.masks = np.concatenate([np.zeros((len(bits), 1), np.uint64), np.bitwise_or.accumulate(bits, axis=1)], axis=1)

    def _distance(self, parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        apart = parts - self.entries[entry]
        return np.einsum("ij,ij->i", apart, apart)

    def __call__(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance), ties to the lower index."""
        n, width = parts.shape
        if not width:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        last = len(self.entries) - 1
        reach = np.full(n, np.iinfo(np.int64).max)
        for axis in range(width):
            beside = np.searchsorted(self.sorted[axis], parts[:, axis])
            for place in (np.minimum(beside, last), np.maximum(beside - 1, 0)):
                np.minimum(reach, self._distance(parts, self.order[axis][place]), out=reach)
        radius = np.floor(np.sqrt(reach.astype(np.float64))).astype(np.int64) + 1  # no less than the root
        box = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        for axis in range(width):
            low = np.searchsorted(self.sorted[axis], parts[:, axis] - radius)
            high = np.searchsorted(self.sorted[axis], parts[:, axis] + radius, side="right")
            box &= self.masks[axis][high] ^ self.masks[axis][low]
        best, least, left = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.arange(n)
        while len(left):
            lowest = box & (~box + _ONE)
            entry = np.log2(lowest.astype(np.float64)).astype(np.int64)
            distance = self._distance(parts[left], entry)
            better = distance < least[left]
            best[left[better]], least[left[better]] = entry[better], distance[better]
            box ^= lowest
            more = box != 0
            left, box = left[more], box[more]
        return best, least


def _cut(vectors: pa.Array, width: int) -> np.ndarray:
    return matrix(vectors, width).reshape(len(vectors), PARTS, width // PARTS)


def _sums(books: np.ndarray, width: int):
    """One row a part position and entry: how many parts it is nearest to, and their sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = [Nearest(book) for book in books]
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            parts = _cut(batch.column("vector"), width)
            for p in range(PARTS):
                entry, _ = nearest[p](parts[:, p])
                count[p] += np.bincount(entry, minlength=len(books[p]))
                np.add.at(total[p], entry, parts[:, p])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
                                          pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])
    return run


def _coded(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = [Nearest(book) for book in books]
        for batch in batches:
            parts = _cut(batch.column("vector"), width)
            found = [nearest[p](parts[:, p]) for p in range(PARTS)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()),
                                              pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
    return run


def codebooks(table: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Part positions x entries x dimensions. ``table``: vec_id, vector (integers)."""
    first = table.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).toArrow()
    books = _cut(first.column("vector").combine_chunks(), width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        told = table.select("vector").mapInArrow(_sums(books, width), "part int, entry int, n long, total array<long>")
        summed = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(j))).alias(f"t{j}") for j in range(width // PARTS)])
        for part, entry, n, *total in summed.collect():  # PARTS x ENTRIES rows at most
            books[part, entry] = [t // n for t in total]
    return books


def vector_codes(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """One row per kept vector (``vec_id``, ``label``, ``code``: a byte a part,
    ``error``: squared distance of vector and code), and the codebooks."""
    table = written(quantised(rows, vector, {"vec_id": vec_id, "label": label}), "vectors")
    greatest = F.greatest(F.abs(F.array_min("vector").cast("long")), F.abs(F.array_max("vector").cast("long")))
    longest, most = table.agg(F.max(F.size("vector")), F.max(greatest)).first()
    if longest is None:
        return table.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    width = -(-longest // PARTS) * PARTS
    if 4 * (most or 0) ** 2 * width >= 2**62:
        raise ValueError("squared distances of these vectors may not fit 62 bits")
    books = codebooks(table, width)
    return table.mapInArrow(_coded(books, width), "vec_id long, label long, code binary, error long"), books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels. A label's rows are dealt
    over ``SALTS`` partitions, to each of which its sum goes."""
    told = written(coded.withColumns({"of": F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label")),
                                      "salt": F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))}), "codes")
    sums = told.groupBy("of").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return told.join(sums, ["of", "salt"]).drop("of", "salt")
