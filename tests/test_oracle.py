"""Every registered query against its DuckDB oracle on sf0.001 (row count,
column names and an order-insensitive value digest) — the driver's gate."""

import re

import pytest

import __spark_entry__ as E
from scripts.check_oracle import digest
from tests.conftest import SMALL
from verity.sources.tables import TABLES

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 32


# The training-data queries have tests of their own in tests/llm.
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "pipeline" and not re.match(r"op\d+_", n)))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows and len(df.columns) == len(set(df.columns))
        return
    rel = duck.sql(ORACLES[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, orows)[0]
