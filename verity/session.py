"""Session helpers.

Library code never creates a session; these helpers are for tests, the bench
and local runs. ``checkpoint_dir`` reads the cluster's shared folder from the
session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "verity",
                  checkpoint: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Scoring is CPU-heavy per byte: keep small shuffle outputs spread
        # over the cores instead of coalescing them into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Larger generated methods are not compiled by the JVM; their expressions are split up then.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", os.environ.get("VERITY_DRIVER_MEMORY", "8g"))
    )
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``),
    registered for ``DataFrame.checkpoint()``. There is no fallback: a folder
    of one machine would be lost with it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name for a job's own tables, below ``spark.checkpoint.dir``. Only
    a local session without one (a test) gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="verity-")
    return f"{base.rstrip('/')}/verity-{name}-{uuid.uuid4().hex}"


# Settings we recommend for a large cluster run (100 TB class); the library
# never sets them itself. Partitions of ~128 MB keep sorts and hash tables in
# memory; AQE coalesces small shuffle outputs, splits skewed join partitions
# and turns joins with small runtime sides into broadcasts (size-checked at
# run time, capped by the threshold below).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.session.timeZone": "UTC",
}
