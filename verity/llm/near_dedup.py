"""Near-dedup by DartMinHash on five-word shingles.

Weighted sets: an element is a shingle, its weight the times it occurs. For each
element, darts fall on the plane of weight and rank as a unit Poisson process
that depends on the element's hash alone. A text sees the darts below its
weights and below a rank at which about ``k ln k + 2k`` darts are seen; each
dart is hashed to one of k coordinates, and the earliest dart in each is the
signature. Two texts agree in a coordinate with a probability equal to their
weighted Jaccard similarity. If a coordinate stays empty the rank is doubled.

``BANDS`` bands of ``ROWS`` coordinates are joined on: texts of similarity 0.8
miss each other in all bands with a chance of 3 in a million.

Links are found in every bucket of a band without listing all its pairs:

- texts that are equal word for word are one node from the start;
- in buckets of up to ``SMALL`` nodes all pairs are compared;
- in larger ones every node is compared to the bucket's leader, the node that
  shares buckets with most others (the text that copies were made from, if it is
  there), and what is linked is merged;
- what is not of the leader's component then gets a leader of its own, ``LEADERS``
  times, so that variants of a text that are like each other merge as soon as one of
  them leads;
- larger buckets that still hold several components are joined by how their texts
  differ from the first leader. Let L be the leader's size, e what a text adds to it, r
  what it lacks and W = 4e + 5r: it is like the leader if W <= L, and texts x and y are
  alike if 9g >= Wx + Wy - L, where g is what their differences share. A pair to be
  found has a text unlike the leader, so g is at least (W + 1) / 9 for either
  text's partner and (W - L) / 5 for that text: the rarest elements of the differences
  (all but g - 1) must meet, and at places that leave room for g. Elements that one
  component alone has, or only texts like the leader, are left out before they are ranked
  (no pair to be found shares one), and of what is left again before the join.

The latter join loses no pair of a bucket, and its work follows what differences of
different components share instead of the square of the bucket.

A comparison is the exact weighted Jaccard similarity of the shingles. Classes
are the connected components of links of 0.8 or more.

Defined results: a null text counts as empty; texts without words are equal to
each other and like nothing else; texts of under five words have one shingle, of
all their words; very long texts are hashed in blocks; the class is the smallest identifier of its rows, null only if
all are; repeated rows fall in one class, one row of which stays; an empty table
gives an empty table; further columns pass through ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.llm.components import components
from verity.llm.pretokens import scramble
from verity.llm.shared import SPACE, few_rows, text_or_empty, written
from verity.llm.words import shingles, strips, word_hashes

SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SMALL = 8
LEADERS = 3  # further ones of a bucket, before the exact join of what they leave apart
SALTS = 16  # tasks over which the partners of one text are dealt
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
_CELL, _DART = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def dart_signatures(elements: np.ndarray, owner: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """The signatures (n x k) of n sets of unit strips; ``owner`` says whose each is."""
    earliest = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    size = np.bincount(owner, minlength=n)
    reach = (k * math.log(k) + 2 * k) / np.maximum(size, 1)
    open_sets = size > 0
    while open_sets.any():
        mine = open_sets[owner]
        strip, of = elements[mine], owner[mine]
        cells = np.ceil(reach[of]).astype(np.int64)
        of, strip = np.repeat(of, cells), np.repeat(strip, cells)
        height = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = scramble(strip + (height + 1).astype(np.uint64) * _CELL)
        thrown = np.searchsorted(_POISSON, (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
        of, height, seed = np.repeat(of, thrown), np.repeat(height, thrown), np.repeat(seed, thrown)
        number = np.arange(len(of)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        dart = scramble(seed + (number + 1).astype(np.uint64) * _DART)
        rank = height + (dart >> np.uint64(40)).astype(np.float64) * 2.0**-24
        seen = rank < reach[of]
        of, dart, rank = of[seen], dart[seen], rank[seen]
        coordinate = (((dart & np.uint64(0xFFFFFF)) * np.uint64(k)) >> np.uint64(24)).astype(np.int64)
        # Earliest first: the rank's bits above, the dart's own mark below.
        marked = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (scramble(dart) >> np.uint64(32))
        np.minimum.at(earliest, of * k + coordinate, marked)
        empty = (earliest.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        open_sets &= empty
        reach = np.where(open_sets, reach * 2, reach)
    return earliest.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    n = len(signatures)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], n, axis=0)
    for r in range(rows):
        key = scramble(key * _DART + signatures.reshape(n, bands, rows)[:, :, r])
    return key


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        ids, nodes = batch.column("doc_id"), batch.column("node")
        for numbers, words in word_hashes(batch.column("text").to_pylist()):
            sets = [strips(shingles(w)) for w in words]
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            signatures = dart_signatures(np.concatenate(sets), owner, len(sets))
            at = pa.array(numbers, pa.int64())
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([ids.take(at), nodes.take(at), lists(band_keys(signatures).view(np.int64)),
                                              pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "node", "bands", "size"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_rows(batches):
        for numbers, words in word_hashes(batch.column("text").to_pylist()):
            at = pa.array(numbers, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), pa.array([np.sort(strips(shingles(w))).tobytes() for w in words], pa.binary())],
                                             names=["node", "strips"])


def node_of(text: str) -> Column:
    """What texts that are equal word for word share. Never null, so that a join need
    not compute it once more to leave nulls out."""
    return F.coalesce(F.unhex(F.md5(F.trim(F.regexp_replace(text_or_empty(text), SPACE, " ")))), F.lit(b""))


def _likeness(host: np.ndarray, guest: np.ndarray) -> tuple[float]:
    p, q = host, guest
    both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= SIMILARITY * max(len(p), len(q)) else 0
    return (both / max(len(p) + len(q) - both, 1),)


def _difference(leader: np.ndarray, text: np.ndarray) -> tuple[int, int, np.ndarray]:
    added, lacked = np.setdiff1d(text, leader, assume_unique=True), np.setdiff1d(leader, text, assume_unique=True)
    return len(leader), 4 * len(added) + 5 * len(lacked), np.concatenate([added, lacked]).view(np.int64)


def _visited(pairs: DataFrame, sets: DataFrame, pick: Callable, found: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """``pick(strips of host, strips of guest)`` for each (host, guest). A host's
    strips go once to each of the at most ``SALTS`` tasks that its guests are dealt to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held = None, None
        for batch in few_rows(batches):
            rows = []
            for key, guest, strips in zip(batch.column("host"), batch.column("guest"), batch.column("strips")):
                if guest.is_valid:
                    rows.append((host, guest.as_py(), *pick(held, np.frombuffer(strips.as_buffer(), np.uint64))))
                else:
                    host, held = key.as_py(), np.frombuffer(strips.as_py(), np.uint64)
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()),
                                                  *[pa.array(c, kind) for c, (_, kind) in zip(columns[2:], found)]], names=["host", "guest", *[n for n, _ in found]])

    salted = pairs.select("host", "guest", F.pmod(F.xxhash64("guest"), F.lit(SALTS)).alias("salt"))
    hosts = salted.select("host", "salt").distinct().join(sets.withColumnRenamed("node", "host"), "host")
    guests = salted.join(sets.withColumnRenamed("node", "guest"), "guest")
    columns = ["host", "salt", "guest", "strips"]
    dealt = hosts.withColumn("guest", F.lit(None).cast("binary")).select(columns).unionByName(guests.select(columns)).repartition("host", "salt")
    return dealt.sortWithinPartitions("host", "salt", F.col("guest").asc_nulls_first()).mapInArrow(run, f"host binary, guest binary, {ddl}")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (host, guest) that are alike, as links (a, b)."""
    found = _visited(pairs, sets, _likeness, [("similarity", pa.float64())], "similarity double")
    return written(found.where(F.col("similarity") >= SIMILARITY).select(F.col("host").alias("a"), F.col("guest").alias("b")), "similar")


def _buckets(keyed: DataFrame) -> DataFrame:
    """``key``, ``node``, the bucket's size ``n`` and ``leader``, for buckets of two
    nodes or more."""
    busy = written(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("in_it")).where("in_it > 1"), "key"), "busy")
    met = busy.groupBy("node").agg(F.sum("in_it").alias("met"))
    rows = busy.select("key", "node").join(met, "node")
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("met")).alias("o"), "node")).alias("leader"))
    return written(rows.select("key", "node").join(buckets.select("key", "n", F.col("leader.node").alias("leader")), "key"), "buckets")


def _pairs(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs (host, guest) of different components to compare: all of a small
    bucket's, and each node of a larger one with its leader."""
    star = shared.where((F.col("n") > SMALL) & (F.col("node") != F.col("leader"))).select(F.col("leader").alias("host"), F.col("node").alias("guest"))
    small = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes"))  # SMALL nodes at most
    each = small.select("nodes", F.posexplode("nodes").alias("i", "host")).select("host", F.explode(F.slice("nodes", F.col("i") + 2, SMALL)).alias("guest"))
    pairs = star.unionByName(each).distinct()
    if roots is None:
        return pairs
    return _rooted(_rooted(pairs, roots, "host"), roots, "guest").where("host_root <> guest_root").select("host", "guest")


def _rooted(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``<column>_root``: the node's component, or itself."""
    known = roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    return rows.join(known, column, "left").withColumn(f"{column}_root", F.coalesce(f"{column}_root", column))


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after these links are added."""
    if roots is None:
        return components(links)
    between = _rooted(_rooted(links, roots, "a"), roots, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    moved = components(between)
    known = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(known.unionByName(moved.join(roots.select("node"), "node", "left_anti")), "roots")


def _rarest(frames: DataFrame, sets: DataFrame) -> DataFrame:
    """For each text of ``frames`` (leader, node, root) the elements of its difference from
    the leader that a partner must share one of, rarest first: ``part``, with
    ``apart`` where the text is unlike the leader and a partner of any kind must
    share it, ``met`` where a partner unlike the leader must, and ``after`` (elements that follow it).
    Only elements that several components have, and a text unlike the leader, count: what
    partners share is of these."""
    pairs = frames.select(F.col("leader").alias("host"), F.col("node").alias("guest"))
    told = _visited(pairs, sets, _difference, [("size", pa.int64()), ("far", pa.int64()), ("unlike", pa.list_(pa.int64()))], "size long, far long, unlike array<long>")
    told = told.select(F.col("host").alias("leader"), F.col("guest").alias("node"), "size", "far", "unlike").join(frames, ["leader", "node"])
    told = written(told, "differences")
    parts = told.select("leader", "node", "root", (F.col("far") > F.col("size")).alias("one"), F.explode("unlike").alias("part"))
    often = parts.groupBy("leader", "part").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"), F.max("one").alias("one"))
    shared = often.where("least <> most and one").select("leader", "part", "n")
    parts = parts.select("leader", "node", "part").join(shared, ["leader", "part"]).groupBy("leader", "node").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts"))
    held = F.size("parts")
    whole = lambda over, by: F.ceil(over / F.lit(by)).cast("int")
    apart = F.when(F.col("far") > F.col("size"), held - whole(F.col("far") - F.col("size"), 5) + 1).otherwise(0)
    ranked = told.drop("unlike").join(parts, ["leader", "node"]).withColumns(
        {"held": held, "first": apart, "any": held - whole(F.col("far") + 1, 9) + 1})
    each = ranked.withColumn("parts", F.slice("parts", 1, F.greatest(F.lit(0), "first", "any"))).select(
        "leader", "node", "root", "size", "far", "held", "first", "any", F.posexplode("parts").alias("place", "one"))
    return written(each.select("leader", "node", "root", "size", "far", F.col("one.part").alias("part"), (F.col("place") < F.col("first")).alias("apart"),
                               (F.col("place") < F.col("any")).alias("met"), (F.col("held") - F.col("place")).alias("after")), "rarest")


def _crossing(rarest: DataFrame) -> DataFrame:
    """The rows whose element more than one component still has, and a text unlike the leader."""
    several = rarest.groupBy("leader", "part").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("apart").alias("one")).where("least <> most and one")
    return written(rarest.join(several.select("leader", "part"), ["leader", "part"], "left_semi"), "crossing")


def _of_others(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of large buckets (key, node) that are not of their leader's component."""
    both = _rooted(_rooted(shared.where(F.col("n") > SMALL), roots, "node"), roots, "leader")
    return both.where("node_root <> leader_root").select("key", "node")


def _pairs_by_difference(rarest: DataFrame) -> DataFrame:
    """Pairs of different components that share an element of their differences,
    at places that leave room for as many as they must share."""
    side = lambda flag, to: rarest.where(flag).select("leader", "part", *[F.col(c).alias(f"{to}_{c}") for c in ("node", "root", "far", "after", "size")])
    met = side("apart", "a").join(side("met", "b"), ["leader", "part"])
    alike = met.where("a_root <> b_root and 9 * least(a_after, b_after) >= a_far + b_far - a_size")
    return alike.select(F.col("a_node").alias("host"), F.col("b_node").alias("guest")).distinct()


def near_roots(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node that has a link of ``SIMILARITY`` or more."""
    nodes = signed.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    shared = _buckets(nodes.select("node", F.explode("bands").alias("key")))
    # Only texts that share a bucket are read again, one for each node.
    wanted = shared.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    texts = docs.select("doc_id", "node", "text").join(wanted.withColumnRenamed("doc_id", "its"), "node").where(F.col("doc_id").eqNullSafe(F.col("its")))
    sets = written(texts.select("node", "text").mapInArrow(_shingled, "node binary, strips binary").groupBy("node").agg(F.first("strips").alias("strips")), "strips")

    roots = _merged(None, _compared(_pairs(shared, None), sets))
    left = shared
    for _ in range(LEADERS):
        left = _buckets(_of_others(left, roots))
        if left.isEmpty():
            break
        roots = _merged(roots, _compared(_pairs(left, roots), sets))
    rooted = written(_rooted(shared.where(F.col("n") > SMALL), roots, "node").select("key", "node", "leader", F.col("node_root").alias("root")), "rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    frames = written(rooted.join(several, "key").where("node <> leader").select("leader", "node", "root").distinct(), "frames")
    if frames.isEmpty():
        return roots
    return _merged(roots, _compared(_pairs_by_difference(_crossing(_rarest(frames, sets))), sets))


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the smallest identifier
    of its class), ``class_size`` and ``kept`` (one row a class)."""
    return _classes(docs, text, doc_id).select("doc_id", "class_id", "class_size", "kept")


def _classes(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), node_of(f"`{text}`").alias("node"), text_or_empty(f"`{text}`").alias("text"))
    signed = written(read.mapInArrow(_signed, "doc_id long, node binary, bands array<long>, size long"), "signed")
    roots = near_roots(read, signed)
    rows = signed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    classes = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least"), F.count("*").alias("class_size"))
    same = Window.partitionBy("doc_id", "node").orderBy("root")
    told = rows.join(classes, "root").withColumn("nth", F.row_number().over(same))
    stays = (F.col("nth") == 1) & (F.col("node") == F.col("least.node")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    return told.select("doc_id", "node", F.col("least.doc_id").alias("class_id"), "class_size", stays.alias("kept"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class, the smallest identifier's; among rows that
    repeat identifier and text, the one whose columns have the least hash."""
    kept = _classes(docs, text, doc_id).where("kept").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col(f"`{doc_id}`").cast("long").alias("_doc"),
                       node_of(f"`{text}`").alias("_same"))
    one = Window.partitionBy("_same", "_doc").orderBy(F.md5(F.to_json("_all")))
    joined = rows.join(kept, (F.col("_same") == F.col("_node")) & F.col("_doc").eqNullSafe(F.col("_id")))
    return joined.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select("_all.*")
