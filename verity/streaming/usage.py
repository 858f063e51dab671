"""Structured Streaming jobs (R1, R2): the same Column logic as batch, fed by
``readStream`` and written with ``writeStream`` (append mode, checkpointed in
the shared folder given by the caller or the session's spark.checkpoint.dir).

R1 (scoring) is stateless. R2 (usage per window) keeps window state bounded by
a watermark: a day window is emitted once the watermark passes its end, so a
drained stream equals the batch result minus the still-open windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verity.operators.sqlbench import score_pairs


def usage_per_window(log: DataFrame, window: str = "1 day", watermark: str | None = "1 hour",
                     ts: str = "ts", model: str = "model", tokens: str = "tokens") -> DataFrame:
    """R2: requests and tokens per (tumbling window, model). Works on a batch
    or a streaming DataFrame; on a stream the watermark bounds the state."""
    src = log.withWatermark(ts, watermark) if (watermark and log.isStreaming) else log
    g = src.groupBy(F.window(ts, window).alias("w"), F.col(model).alias("model")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(tokens).cast("bigint").alias("tokens"))
    return g.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
        "model", "requests", "tokens",
    )


def _checkpoint(spark: SparkSession, checkpoint: str | None, name: str) -> str:
    if checkpoint:
        return checkpoint
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("pass checkpoint= or set spark.checkpoint.dir to a shared folder")
    return f"{base.rstrip('/')}/{name}"


def run_usage_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint: str | None = None,
                     window: str = "1 day", watermark: str = "1 hour") -> StreamingQuery:
    """R2 as a stream: parquet request-log files in ``source_dir`` -> usage
    rows appended to ``sink_dir`` as windows close. ``availableNow`` drains
    what is there and stops; restarts resume from the checkpoint."""
    log = spark.readStream.schema(schema).parquet(source_dir)
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    out = usage_per_window(log, window, watermark)
    return (out.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", _checkpoint(spark, checkpoint, "usage"))
            .trigger(availableNow=True).start(sink_dir))


def run_scoring_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint: str | None = None,
                       generated: str = "generated", reference: str = "reference") -> StreamingQuery:
    """Score a stream of (generated, reference) pairs with the batch
    scorer (stateless, append)."""
    pairs = spark.readStream.schema(schema).parquet(source_dir)
    scored = score_pairs(pairs, generated, reference)
    return (scored.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", _checkpoint(spark, checkpoint, "scoring"))
            .trigger(availableNow=True).start(sink_dir))
