"""Registry of named queries: each is a Spark builder ``(spark, sf_dir) ->
DataFrame`` and, where the semantics are SQL-expressible, a DuckDB SQL string
computing the same rows over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every query module so their ``@register`` calls run."""
    from verity.plans import (  # noqa: F401
        q_analytics, q_financial, q_replay, q_requests, q_sqlbench, q_streaming, q_text, q_workload,
    )
