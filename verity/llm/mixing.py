"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is its weight's share of all words, held at ``most`` times
what the source has, the excess shared anew by weight. Within a source, whole
epochs come first: a target of 2.4 times the source takes every document twice,
and the rest is drawn without replacement: a document's key is
``-ln(u) / q`` with ``u`` from a hash of its identifier and ``q`` its quality,
and documents are taken by rising key until the prefix sum of their words
reaches the budget; the last one is cut there.

A source may hold a third of all rows: prefix sums run per (source, slice of the
key), with the slices' totals, a bounded number a source, summed first. Slices rise
with the key by the mean of the distributions that the possible qualities give it,
so of rows of any quality a slice holds a ten-SLICES-th at most.

Defined results: a null text has no words and is never taken; null sources come
last in the order of sources; repeated rows are documents of their own, ordered
by key, identifier, size, then a hash of the text and of what is carried along, so
that reruns agree whatever the order of the input, and rows with the same identifier
share one draw; very long texts count whole; an empty table gives an empty table;
further columns pass through ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.llm.shared import SPACE, WORD, text_or_empty, word_count, written

WEIGHTS = (5, 2, 1)
MOST = 3
SLICES = 4096
STEPS = 10  # of quality


def quality(text: Column) -> Column:
    """Between 0.1 and 1: the share of letters (of any script) and blanks in the text, in steps of 0.1."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]", ""))
    return F.greatest(F.lit(1), F.floor(STEPS * plain / F.greatest(F.length(text), F.lit(1)))).cast("double") / STEPS


def draw(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the identifier and the seed alone (52 bits of a hash)."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its words, and its target. With sources ordered by
    cap over weight, those that stop at their cap are a prefix of that order, so
    one running sum finds the level at which the rest share what is left.
    The windows run over one row a source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    sources = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    everything, rising = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    ruled = sources.withColumns({
        "all_words": F.sum("source_size").over(everything),
        "left_words": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    # The first source that stays below its cap sets the level for all after it.
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("left_words"), F.col("left_weight")))).over(everything)
    level = ruled.withColumn("level", first)
    shared = (F.col("weight") * F.col("level.left_words")).cast("double") / F.col("level.left_weight").cast("double")
    return level.select("source", "source_size", F.when(F.col("capped") | F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        shared).alias("target"))


def mix_plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
             most: int = MOST, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``,
    ``taken`` (words the mix takes of it, repeats counted), and how that comes
    about: ``epochs`` whole passes and ``drawn`` words from one more. The
    columns named in ``carry`` come along as the struct ``carried``."""
    body = text_or_empty(f"`{text}`")
    key = -F.ln(draw(F.col(f"`{doc_id}`"), seed)) / quality(body)
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                        word_count(body).alias("size"), key.alias("key"), F.md5(body).alias("mark"), *kept)
    spread = sum((1 - F.exp(-F.col("key") * q / STEPS) for q in range(1, STEPS + 1)), F.lit(0.0)) / STEPS
    sized = written(sized.withColumn("slice", F.floor(spread * SLICES)), "sized")
    # A null source gets a key of its own that no name can equal.
    sized = sized.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    ahead = Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("of", "slice").agg(F.sum("size").alias("slice_size"))
    sums = sums.select("of", "slice", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("ahead"))
    targets = source_targets(sized, weights, most).withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    order = ["key", F.col("doc_id").asc_nulls_last(), "size", "mark", *([F.md5(F.to_json("carried"))] if carry else [])]
    within = Window.partitionBy("of", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums.join(targets, "of"), ["of", "slice"])
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budget = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    rows = rows.withColumn("drawn", F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("ahead") - F.col("inside"))).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("drawn")).alias("taken"),
                       "epochs", "drawn", *(["carried"] if carry else []))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: every document once for
    each whole epoch and once more where it is drawn. The one document in each
    source at which the budget ends is cut after its last drawn word."""
    plan = mix_plan(docs, text, doc_id, source, carry=docs.columns, **settings)
    copies = F.col("epochs") + (F.col("drawn") > 0).cast("long")
    rows = plan.where(copies > 0).select("size", "epochs", "drawn", "carried", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("pass"))
    cut = (F.col("pass") > F.col("epochs")) & (F.col("drawn") < F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(f"carried.`{text}`"), F.lit(f"({SPACE}|^){WORD}"), F.lit(0)), 1, F.col("drawn").cast("int")), "")
    return rows.select(*[(F.when(cut, head).otherwise(F.col(f"carried.`{c}`")) if c == text else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])
