"""Wide or heavy rows made from one small file: dealt over as many tasks as the data has shuffle partitions."""

import random

import pytest

from tests.conftest import SMALL
from verity.operators import sqlbench as B
from verity.operators.partitioning import HEAVY_TASK_BYTES, tasks
from verity.plans import q_analytics as A
from verity.plans import q_sqlbench as Q
from verity.sources import fixtures as X


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    yield 29
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_prompts_are_made_in_many_tasks(spark, many_partitions):
    assert tasks(spark) >= many_partitions
    assert Q.sql_prompts(spark, SMALL).rdd.getNumPartitions() >= many_partitions


def test_scoring_tasks_are_not_merged_by_their_bytes(spark, many_partitions):
    samples = X.corpus(spark, SMALL).select("sample_id", "complexity", "query")
    pairs = B.responses_with_reference(samples, X.sql_responses(spark, SMALL), prepare=True)
    assert pairs.rdd.getNumPartitions() == tasks(spark)


def test_references_are_prepared_once_a_sample(spark):
    prepared, plain = B.score_pairs(X.sql_pairs(spark, SMALL, B.reference_forms), prepared=True), B.score_pairs(X.sql_pairs(spark, SMALL))
    assert sorted(prepared.columns) == sorted(plain.columns)
    rows = lambda df: sorted(map(str, df.select(*sorted(plain.columns)).collect()))
    assert rows(prepared) == rows(plain)
    plan = prepared._jdf.queryExecution().optimizedPlan().toString()
    assert "_rh4" in plan[plan.index("Join Cross" if "Join Cross" in plan else "Join"):]


def test_scoring_tasks_grow_with_the_samples(spark, tmp_path):
    """With shuffle partitions fixed, a task's share of the samples stays the same."""
    draw = random.Random(5)
    rows = [(i, "medium", "%0100x" % draw.getrandbits(400)) for i in range(50_000)]
    spark.createDataFrame(rows, "sample_id long, complexity string, query string").coalesce(1).write.parquet(str(tmp_path / "s"))
    samples = spark.read.parquet(str(tmp_path / "s"))
    answers = samples.selectExpr("sample_id", "query as response")
    stored = sum(f.stat().st_size for f in (tmp_path / "s").glob("*.parquet"))
    pairs = B.responses_with_reference(samples, answers, prepare=True)
    assert stored > 2 * tasks(spark) * HEAVY_TASK_BYTES
    assert pairs.rdd.getNumPartitions() >= stored // HEAVY_TASK_BYTES


def test_samples_are_dealt_before_their_forms_are_made(spark):
    """The forms, many times as wide as their text, are not shuffled."""
    samples = X.corpus(spark, SMALL).select("sample_id", "complexity", "query")
    pairs = B.responses_with_reference(samples, X.sql_responses(spark, SMALL), prepare=True)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    side = plan[plan.rindex("RepartitionByExpression"):]
    assert "_r_flags" in plan and "_r_flags" not in side


def test_domains_are_chosen_before_scoring(spark):
    """a17 scores the responses that it reports."""
    plan = A.a17_report_by_domain(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")
