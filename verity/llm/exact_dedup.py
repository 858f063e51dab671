"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes (their first ``HEAD``,
then the digest of all; ties are broken by identifier, so one text that makes up
a third of all rows spreads over many partitions), an external sort puts equals next to each other, and each row's
full text is compared with its neighbour's. Runs that cross a partition's edge
are joined through a table of two rows a partition.

Defined results: a null text counts as empty; a null identifier sorts last, so
it stays only where its whole group has none; rows that repeat both text and
identifier are one group of which one row stays, the one whose columns have the least
hash; very long texts are sorted and compared whole; an empty table gives an empty table; further columns are passed through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.llm.shared import SPACE, few_rows, partitions, text_or_empty, written

HEAD = 64  # bytes of a text by which it is dealt out


def _run_schema(row: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("_id", T.LongType()), T.StructField("_row", row), T.StructField("_part", T.IntegerType()),
        T.StructField("_run", T.LongType()), T.StructField("_first", T.BooleanType()), T.StructField("_sha", T.StringType()),
    ])


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, before, run = TaskContext.get().partitionId(), None, -1
    for batch in few_rows(batches):
        runs, firsts = [], []
        for body in batch.column("_body"):
            body = body.as_py()
            first = body != before
            if first:
                before, run = body, run + 1
            runs.append(run)
            firsts.append(first)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_row"), pa.array([part] * len(runs), pa.int32()),
             pa.array(runs, pa.int64()), pa.array(firsts, pa.bool_()), batch.column("_sha")],
            names=["_id", "_row", "_part", "_run", "_first", "_sha"])


def sorted_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per document: ``_id``, ``_row`` (the column ``row``, carried
    through), and its run of equal texts as ``_part``, ``_run`` with ``_first``
    at the run's first row and the text's ``_sha``. Written, as range bounds
    are sampled anew by every job."""
    body = F.regexp_replace(text_or_empty(f"`{text}`"), SPACE, " ").cast("binary")
    # Splitters travel to the driver: they are the first bytes and the digest of
    # a text, never the whole of it. Rows are still compared whole.
    carried = F.col(f"`{row}`") if row else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), body.alias("_body"), carried.alias("_row"))
    rows = rows.withColumns({"_head": F.substring("_body", 1, HEAD), "_sha": F.sha2("_body", 256)})
    # Rows that repeat text and identifier go by a hash of what they carry.
    number, tie = F.col("_id").asc_nulls_last(), [F.md5(F.to_json("_row"))] if row else []
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "_head", "_sha", number).sortWithinPartitions("_head", "_sha", "_body", number, *tie)
    return written(ordered.mapInArrow(_compare_neighbours, _run_schema(rows.schema["_row"].dataType)), "runs")


def edge_groups(runs: DataFrame) -> DataFrame:
    """The groups whose runs touch a partition's edge, by ``(_part, _run)``:
    ``_keep``, ``_size`` and ``_home`` (the partition that holds the row that
    stays). At most two rows a partition, so it may be broadcast."""
    by_run = runs.groupBy("_part", "_run").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"), F.first("_sha").alias("_sha"))
    last = runs.groupBy("_part").agg(F.max("_run").alias("_last"))
    edge = by_run.join(F.broadcast(last), "_part").where("_run = 0 or _run = _last")
    whole = Window.partitionBy("_sha")
    return edge.select("_part", "_run", F.min("_least").over(whole).alias("_keep"), F.sum("_n").over(whole).alias("_size"),
                       F.min("_part").over(whole).alias("_home"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``
    and ``text_sha256`` of the normalised text."""
    runs = sorted_runs(docs, text, doc_id)
    run = Window.partitionBy("_part", "_run")
    return runs.withColumns({"_n": F.count("*").over(run), "_least": F.min("_id").over(run)}).join(
        F.broadcast(edge_groups(runs)), ["_part", "_run"], "left").select(
        F.col("_id").alias("doc_id"),
        F.coalesce("_keep", "_least").alias("keep_id"),
        F.coalesce("_size", "_n").alias("group_size"),
        (F.col("_first") & (F.coalesce("_home", "_part") == F.col("_part"))).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the smallest identifier's."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    rows = packed.select(F.col(f"_all.`{text}`").alias("_t"), F.col(f"_all.`{doc_id}`").alias("_d"), "_all")
    runs = sorted_runs(rows, "_t", "_d", row="_all")
    kept = runs.where("_first").join(F.broadcast(edge_groups(runs.drop("_row"))), ["_part", "_run"], "left").where(
        F.coalesce("_home", "_part") == F.col("_part"))
    return kept.select("_row.*")
