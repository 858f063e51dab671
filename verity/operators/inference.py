"""Batch inference with ``mapInPandas``.

A user-supplied ``client_factory()`` is called once per partition (a model
client, a connection pool); ``client(prompts: list[str]) -> list[str]`` answers
a batch. Per-row failures become an ``error`` value instead of failing the
task. Calls are costly and not repeatable: write the result to storage before
scoring it (``persist_responses``), so a retried or re-planned scoring stage
never calls the model again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RESPONSE_FIELDS = "response string, time_s double, error string, tokens long"


def _answers(client: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple[str | None, float, str | None]]:
    """(answer, seconds, error) of each prompt. If the batch fails, or the
    client returns another number of answers, the prompts go one by one, so
    that only those fail that fail alone."""
    t0 = time.perf_counter()
    try:
        answers = list(client(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
    except Exception as ex:  # noqa: BLE001 - becomes the row's error
        if len(prompts) == 1:
            return [(None, time.perf_counter() - t0, str(ex))]
        return [_answers(client, [p])[0] for p in prompts]
    each = (time.perf_counter() - t0) / max(len(prompts), 1)
    return [(a, each, None) for a in answers]


def generate(df: DataFrame, prompt: str, client_factory: Callable[[], Callable[[list[str]], list[str]]],
             batch_rows: int = 64) -> DataFrame:
    """Add ``response``, ``time_s`` (a batch's time spread over its rows, or the
    row's own if it went alone), ``error`` and ``tokens`` (white-space words of
    prompt and response) to every row by calling the client on Arrow batches."""
    import pandas as pd

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(RESPONSE_FIELDS).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start:start + batch_rows].copy()
                prompts = part[prompt].fillna("").tolist()
                done = _answers(client, prompts)
                part["response"], part["time_s"], part["error"] = ([d[i] for d in done] for i in range(3))
                part["tokens"] = [len(p.split()) + len((d[0] or "").split()) for p, d in zip(prompts, done)]
                yield part

    return df.mapInPandas(run, schema)


def echo_client_factory():
    """A stand-in client answering each prompt with itself (tests, dry runs)."""
    return lambda prompts: list(prompts)


def persist_responses(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write generated responses once and read them back, cutting lineage so
    the model is never called twice for the same rows."""
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
