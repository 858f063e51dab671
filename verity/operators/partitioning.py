"""Partitioning helpers: spreading rows that are heavy on CPU or grow wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tasks(spark: SparkSession) -> int:
    """How many tasks heavy work is dealt to: ``spark.sql.shuffle.partitions``, which is set
    by the size of the data, and at least one a core."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a narrow scan over at least ``min_partitions`` tasks (default: ``tasks``).

    Meant for per-row work that is heavy on CPU (regex scoring) or makes wide rows
    (prompts), fed by a scan with few splits (one small file): one task a core would grow
    with the input. A wide input is returned unchanged, so at scale,
    where scans have thousands of splits, this adds no shuffle. Call it on
    scan-side plans only: the partition count of a plain scan is known from
    its file splits without running anything."""
    target = min_partitions or tasks(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= target else df.repartition(target)


# A task of heavy work takes the rows of this much of its source as stored; beyond
# MOST_TASKS tasks, ``spark.sql.shuffle.partitions`` alone asks for more.
HEAVY_TASK_BYTES = 256 * 1024
MOST_TASKS = 20_000


def heavy_tasks(source: DataFrame) -> int:
    """``tasks``, and enough of them that a task's share does not grow with ``source`` where
    the shuffle partitions are fixed. ``source`` is a scan-side plan, whose size the planner
    takes from its files without running anything."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(tasks(source.sparkSession), min(MOST_TASKS, -(-size // HEAVY_TASK_BYTES)))


def dealt(df: DataFrame, *keys: str, count: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` over ``count`` tasks (default: ``tasks``), which Spark does not merge
    again by their bytes: what follows is heavier than the bytes it reads. For keys that are not hot."""
    return df.repartition(count or tasks(df.sparkSession), *keys)
