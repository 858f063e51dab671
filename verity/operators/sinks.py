"""Sinks (S4-S8, S11) and latest-artefact selection.

Results are tables, written with Spark's commit protocol (no lock, no rewrite
of the whole log per request). Only report text is coalesced to one file, and
only because a report is small by construction (a row per cell of a summary).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_log(df: DataFrame, path: str) -> None:
    """Append request-log rows (timestamp, input, output ...)."""
    df.write.mode("append").parquet(path)


def write_log_epoch(df: DataFrame, epoch: int, path: str) -> None:
    """The log rows of one epoch of a stream, in a folder of their own: an
    epoch that is replayed after a failure replaces what it had written."""
    (df.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("epoch").parquet(path))


def run_log_stream(log: DataFrame, path: str, checkpoint: str, request_id: str = "request_id", ts: str = "ts",
                   delay: str = "1 hour") -> StreamingQuery:
    """S4/U8 as a stream: each request is logged once, however often its row comes
    within ``delay`` of the newest one; rows older than that are late and dropped
    (the state is bounded by the same delay). Null identifiers count as one request."""
    once = log.withWatermark(ts, delay).dropDuplicatesWithinWatermark([request_id])
    return (once.writeStream.foreachBatch(lambda batch, epoch: write_log_epoch(batch, epoch, path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_results(df: DataFrame, path: str, partition_by: str = "run_id") -> None:
    """Results as JSON lines, one folder per run (file-name fields of
    the reference become the partition column). A rerun replaces its own run's
    folder and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).json(path)


def results_tree(summary: DataFrame, keys: tuple[str, ...] = ("model", "complexity", "approach"), run_id: str = "run_id") -> DataFrame:
    """The nested results of each run: a map by the first key of maps by the
    next ones, with a struct of the other columns in the leaves. Cells of a run are
    few (models x levels x approaches). A null key is named ``unknown``; of cells with equal keys
    the greatest stays."""
    leaf = [c for c in summary.columns if c not in (*keys, run_id)]
    rows = summary.select(run_id, *[F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys], F.struct(*leaf).alias("tree"))
    rows = rows.groupBy(run_id, *keys).agg(F.max("tree").alias("tree"))
    for depth in range(len(keys) - 1, -1, -1):
        rows = rows.groupBy(run_id, *keys[:depth]).agg(F.map_from_entries(F.collect_list(F.struct(keys[depth], "tree"))).alias("tree"))
    return rows


def write_table_csv(df: DataFrame, path: str) -> None:
    """Comparison table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """S7 read-back with an explicit schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_task_tables(df: DataFrame, path: str, task: str = "task_type") -> None:
    """Per-task comparison tables as CSV and JSON records."""
    df.write.mode("overwrite").partitionBy(task).option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").partitionBy(task).json(f"{path}/json")


def report_lines(df: DataFrame, title: str, label: str, order: list[str]) -> DataFrame:
    """A Markdown table (one text row per summary row, with header rows)
    from a frame with ``label``, approach, exact_match_pct,
    execution_match_pct, time_ms and tokens."""
    def f1(c):  # %.1f by exact half-up decimal rounding
        return F.round(F.col(c).cast("decimal(24,6)"), 1).cast("string")

    body = df.select(*order, F.concat(
        F.lit("| "), F.col(label), F.lit(" | "), F.col("approach"), F.lit(" | "), f1("exact_match_pct"),
        F.lit("% | "), f1("execution_match_pct"), F.lit("% | "), f1("time_ms"), F.lit(" | "), f1("tokens"),
        F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame(
        [(0, i, v) for i, v in enumerate([f"# {title}", "", f"| {label} | Approach | Exact Match | Execution Match | "
                                          "Time (ms) | Tokens |", "|---|---|---|---|---|---|"])],
        "_grp int, _i int, value string")
    both = head.unionByName(body.withColumn("_grp", F.lit(1)), allowMissingColumns=True)
    # A global sort, then coalesce(1), keeps the order in the written file.
    return both.orderBy("_grp", "_i", *order).select("value")


def write_report(lines: DataFrame, path: str) -> None:
    """Write report text as one file (a report is small by construction)."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def latest_run(runs: DataFrame, kind: str = "kind", run_id: str = "run_id") -> DataFrame:
    """Newest run id per artefact kind (run ids sort as time stamps)."""
    return runs.groupBy(kind).agg(F.max(run_id).alias("latest_run_id"))
