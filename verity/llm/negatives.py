"""Hard negatives by Kronecker-packed products.

Every row's score against an anchor is an exact integer inner product. Candidates
are packed several to a number: component j of the first, second ... candidate,
biased so that none is negative, fill separate fields of one 64-bit number. One
product of such a number with the anchor's component j multiplies all of its fields
at once. Summed over j, and with the bias taken out again, each field holds one
score plus ``most``, the largest squared length of a vector, which bounds every score
(Cauchy-Schwarz); so a field of ``bits(2 most)`` never runs over into the next. All
of it is arithmetic modulo 2^64, where only the final fields have to fit.

Rows are dealt to groups of at most about ``GROUP`` candidates by a hash of their
number, whatever their label, and the anchors, a stated share of the rows, visit each
group: sorted behind the group's candidates they stream past the packed block, and
leave their best few of the group. A first visit finds an anchor's positives
among the rows of its label, a second one the negatives in reach of each positive.

Defined results: rows with a null label, a null vector, or a null or non-finite component
take no part; a null identifier comes last among ties and is no anchor; a missing component
of a shorter vector counts as zero; rows that repeat an identifier are rows of
their own (a repeated anchor is mined as often, and its twin may be its positive), ties beyond
the identifier go by row number; an anchor without positives or negatives in reach
gives no row; an empty table gives an empty table; other columns are not read.
Scores that could leave 56 bits raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.llm.shared import partitions, written
from verity.llm.vectors import matrix, quantised

GROUP = 1 << 18
TILE = 2048  # packed numbers multiplied at a time
POSITIVES, NEGATIVES = 5, 5
LEAST_SHARE, WHOLE = 80, 100
_LAST = np.iinfo(np.int64).max


class Packed:
    """Candidates of one label-sorted group, several in each number."""

    def __init__(self, vectors: np.ndarray, bias: int, most: int) -> None:
        self.n, width = vectors.shape
        self.bits = max((2 * most).bit_length(), 1)
        self.fields = max(64 // self.bits, 1)
        self.bias, self.most = bias, most
        slots = -(-self.n // self.fields)
        biased = np.zeros((slots * self.fields, width), np.uint64)
        biased[: self.n] = (vectors + bias).astype(np.uint64)
        shifts = (np.arange(self.fields, dtype=np.uint64) * np.uint64(self.bits))[None, :, None]
        self.numbers = np.ascontiguousarray(np.bitwise_or.reduce(biased.reshape(slots, self.fields, width) << shifts, axis=1).T)

    def scores(self, anchors: np.ndarray, first: int, last: int) -> np.ndarray:
        """The products of ``anchors`` with the candidates ``first`` to ``last``."""
        begin, end = first // self.fields, -(-last // self.fields)
        out = np.empty((len(anchors), end - begin, self.fields), np.int64)
        factors = anchors.astype(np.int64).view(np.uint64)
        # The bias adds its multiple of the anchor's sum to each field; ``most`` keeps fields from falling below zero.
        ones = np.uint64(sum(1 << self.bits * f for f in range(self.fields)))
        offset = (self.most - self.bias * anchors.sum(axis=1)).astype(np.int64).view(np.uint64) * ones
        for at in range(begin, end, TILE):
            tile = self.numbers[:, at: min(at + TILE, end)]
            sums = np.repeat(offset[:, None], tile.shape[1], axis=1)
            product = np.empty_like(sums)
            for j in range(len(tile)):
                sums += np.multiply(factors[:, j, None], tile[None, j], out=product)
            for f in range(self.fields):
                field = sums >> np.uint64(self.bits * f)
                if self.bits < 64:
                    field &= np.uint64((1 << self.bits) - 1)
                out[:, at - begin: at - begin + tile.shape[1], f] = field.view(np.int64) - self.most
        start = first - begin * self.fields
        return out.reshape(len(anchors), -1)[:, start: start + last - first]


class Group:
    """One group's candidates, sorted by label, identifier and number."""

    def __init__(self, batches: list[pa.RecordBatch], bias: int, most: int, width: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        label, number, row = (table.column(c).fill_null(_LAST).to_numpy() for c in ("label", "vec_id", "row"))
        order = np.lexsort((row, number, label))
        self.label, self.number, self.row = label[order], number[order], row[order]
        self.packed = Packed(matrix(table.column("vector").chunk(0), width)[order], bias, most)

    def same(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, side="right"))


def _best(scores: np.ndarray, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places in the order of falling score, rising identifier and row."""
    return np.lexsort((rows, numbers, -scores))


def _nearest(group: Group, labels: np.ndarray, rows: np.ndarray, anchors: np.ndarray, _limits: list) -> list[tuple[int, int, int, int, int]]:
    """For each anchor the best rows of its label but itself: (anchor, 0, identifier, row, score)."""
    found = []
    for label in np.unique(labels).tolist():
        of, (first, last) = np.flatnonzero(labels == label), group.same(label)
        if first == last:
            continue
        for i, scores in zip(of.tolist(), group.packed.scores(anchors[of], first, last)):
            scores = np.where(group.row[first:last] == rows[i], -(2**62) * 2, scores)
            least = np.partition(scores, -min(POSITIVES, len(scores)))[-min(POSITIVES, len(scores))]
            some = np.flatnonzero((scores >= least) & (scores > -(2**62) * 2))
            best = some[_best(scores[some], group.number[first:last][some], group.row[first:last][some])][:POSITIVES] + first
            found += [(i, 0, group.number[b], group.row[b], s) for b, s in zip(best.tolist(), scores[best - first].tolist())]
    return found


def _in_reach(group: Group, labels: np.ndarray, _rows: np.ndarray, anchors: np.ndarray, limits: list) -> list[tuple[int, int, int, int, int]]:
    """For each anchor and positive score the best rows of other labels in reach of it."""
    found = []
    for i, scores in enumerate(group.packed.scores(anchors, 0, len(group.row))):
        most, least = max(limits[i]), min(limits[i])
        if most < 0:
            continue  # 80 p <= 100 p needs p >= 0
        able = (scores <= most) & (WHOLE * scores >= LEAST_SHARE * max(least, 0)) & (group.label != labels[i])
        some = np.flatnonzero(able)
        if not len(some):
            continue
        some = some[_best(scores[some], group.number[some], group.row[some])]
        falling = -scores[some]
        for limit in set(limits[i]):
            first = int(np.searchsorted(falling, -limit))
            best = [b for b in some[first: first + NEGATIVES].tolist() if WHOLE * scores[b] >= LEAST_SHARE * limit]
            found += [(i, limit, group.number[b], group.row[b], scores[b]) for b in best]
    return found


def _visits(pick: Callable, bias: int, most: int, width: int):
    """Streams sorted rows: of each group first its candidates, then the anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, group = None, [], None
        for batch in batches:
            keys, visiting = batch.column("group").to_numpy(), batch.column("visits").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (visiting[1:] != visiting[:-1])) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if first == last:
                    continue
                some = batch.slice(first, last - first)
                if keys[first] != current:
                    current, waiting, group = keys[first], [], None
                if not visiting[first]:
                    waiting.append(some)
                    continue
                if group is None and waiting:
                    group, waiting = Group(waiting, bias, most, width), []
                for at in range(0, some.num_rows if group else 0, 16):
                    few = some.slice(at, 16)
                    labels, rows = few.column("label").to_numpy(), few.column("row").to_numpy()
                    limits = few.column("limits").to_pylist()
                    found = pick(group, labels, rows, matrix(few.column("vector"), width), limits)
                    if found:
                        of, limit, number, row, score = (np.array(c, np.int64) for c in zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(rows[of]), pa.array(limit), pa.array(number, mask=number == _LAST), pa.array(row), pa.array(score)],
                                                         names=["row", "limit", "other_id", "other_row", "score"])
    return run


def _visited(candidates: DataFrame, anchors: DataFrame, groups: int, pick: Callable, bias: int, most: int, width: int, keep: int) -> DataFrame:
    """The best ``keep`` of all groups for each anchor ``row`` and ``limit``, with their ``rank``."""
    none = F.lit(None).cast("array<long>")
    dealt = candidates.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"), F.lit(False).alias("visits"), "vec_id", "label", "row", "vector", none.alias("limits"))
    guests = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.lit(True).alias("visits"),
                            "vec_id", "label", "row", "vector", "limits")
    told = dealt.unionByName(guests).repartitionById(groups, F.col("group").cast("int")).sortWithinPartitions("group", "visits")
    found = told.mapInArrow(_visits(pick, bias, most, width), "row long, limit long, other_id long, other_row long, score long")
    best = Window.partitionBy("row", "limit").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other_row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, is_anchor: Column, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """One row per anchor, positive and negative: ``anchor_id``, ``positive_id``,
    ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.
    ``is_anchor`` is a condition on ``vec_id`` and ``label``."""
    whole = quantised(rows, vector, {"vec_id": vec_id, "label": label}).where(F.col("label").isNotNull())
    table = written(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    greatest = F.greatest(F.abs(F.array_min("vector").cast("long")), F.abs(F.array_max("vector").cast("long")))
    n, bias, square, width = table.agg(F.count("*"), F.max(greatest), F.max(square), F.max(F.size("vector"))).first()
    bias, width, most = bias or 0, width or 0, int((square or 0.0) * (1 + 2**-40)) + 1  # a double may have rounded the sum
    if most >= 2**56:
        raise ValueError("inner products of these vectors may not fit the integers used here")
    # Groups of at most GROUP rows, and where there are few rows enough of them for all tasks.
    groups = max(-(-n // GROUP), min(partitions(rows.sparkSession), -(-n // 512)), 1)
    anchors = table.where(is_anchor)
    settings = (bias, most, width)
    positives = _visited(table, anchors.withColumn("limits", F.lit(None).cast("array<long>")), groups, _nearest, *settings, POSITIVES)
    positives = written(positives.select("row", F.col("other_id").alias("positive_id"), F.col("other_row").alias("positive_row"), F.col("score").alias("limit")), "positives")
    limits = positives.groupBy("row").agg(F.collect_set("limit").alias("limits"))  # POSITIVES at most
    negatives = _visited(table, anchors.join(limits, "row"), groups, _in_reach, *settings, NEGATIVES)
    told = positives.join(negatives, ["row", "limit"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return told.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"),
                       F.col("limit").alias("positive_score"), F.col("score").alias("negative_score"))
