"""From raw documents to packed sequences, in five written stages.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is
written as Parquet in the shared folder and read again as the next one's
``docs``. When a stage starts, the tables that the stage before it wrote for its
own use are deleted: its result is written by then. All but the last return the
columns of ``documents``:

1. quality rules: documents that the rules reject go;
2. exact dedup: one row of each group of equal texts stays, the smallest doc_id's;
3. MinHash near-dedup: one document of each group of near copies stays;
4. mixing: documents repeated, drawn or left out, so that sources meet their targets;
5. packing: one row per piece of a document in a sequence of 4096 tokens.

Defined results: as the operators have them. Null texts count as empty, and quality
rules reject documents without words; of rows that repeat identifier and text one
stays; null identifiers and sources are values of their own; columns beside those of
``documents`` pass through all stages but the last, whatever their names; an empty
table gives an empty table.

The quality verdict is estimated from the corpus, so SQL cannot state the rows
of ``run``; tests/llm holds the stages against brute-force versions instead.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verity.llm import exact_dedup, mixing, near_dedup, packing, quality
from verity.llm.queries import TOKENIZER
from verity.llm.shared import cleared, noting, written
from verity.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# The tables that the last stage of this thread's pipeline wrote for its own use.
_OWN_TABLES: ContextVar[list[str] | None] = ContextVar("own_tables", default=None)


def stage(build: Stage) -> Stage:
    @wraps(build)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths = _OWN_TABLES.get()
        if paths is None:
            _OWN_TABLES.set(paths := [])
        cleared(spark, paths)
        with noting(paths):
            return build(spark, docs, sf_dir)
    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs)


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@stage
def packing_in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", source_mix),
    ("packing", packing_in_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(spark, table(spark, sf_dir, "documents"), sf_dir)


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages on ``docs``. The run's own tables are its alone, so pipelines
    may run side by side; none but the result is left."""
    token = _OWN_TABLES.set([])
    stages: list[str] = []
    try:
        for name, build in STAGES:
            read, stages = stages, []
            made = build(spark, docs, sf_dir)
            with noting(stages):
                docs = written(made, name)
            cleared(spark, read)
        cleared(spark, _OWN_TABLES.get())
    finally:
        _OWN_TABLES.reset(token)
    return docs
