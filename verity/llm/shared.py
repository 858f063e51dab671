"""Helpers shared by the operators: written tables and the words of a text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local
    session that names none (a test) gets a scratch folder; on a cluster it would
    be another one on every machine, so there the lack of a name is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="verity-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def noted(path: str) -> str:
    """``path``, added to the folders that ``noting`` collects."""
    if _NOTED.get() is not None:
        _NOTED.get().append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run meanwhile pass so many rows at once to Python workers: a batch of
    long texts is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later
    steps see one fixed set of rows, compute nothing twice, and survive the
    loss of executors. The folder is the caller's to clear after the job;
    ``noting`` says which folders those are."""
    path = noted(f"{shared_folder(df.sparkSession)}/verity-{name}-{uuid.uuid4().hex}")
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Adds the folders of tables written meanwhile to ``paths``."""
    token = _NOTED.set(paths)
    try:
        yield
    finally:
        _NOTED.reset(token)


def cleared(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the folders, which no table still to be read may come from."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _give_back() -> None:
    """Returns freed memory to the system: a worker that lives through many tasks
    would else keep the most that each allocator ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that a Python worker holds the
    texts of a slice and not of a whole Arrow batch as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        _give_back()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
