"""U10's report holds the tables that A2-A7 compute one by one, and reads the facts once."""

from pyspark.sql import functions as F

from tests.conftest import SMALL
from verity.operators import analytics as A
from verity.sources import fixtures as X

MODELS = ("m0", "m1", "m2")


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def test_cut_tables_equal_single_operators(spark):
    runs = X.runs(spark, SMALL)
    out = A.run_general_benchmark(runs, MODELS)
    approach = A.model_means(runs)
    task = A.model_means(runs, ("model", "task_type", "approach"), count=True)
    want = {"approaches": approach, "task_specific": task,
            "input_length_impact": A.model_means(runs, ("model", "input_length", "approach")).drop("retries"),
            "best_performing": A.best_model(approach, MODELS, ["approach"], A.GENERAL_METRICS),
            "task_specific_best": A.best_model(task, MODELS, ["task_type", "approach"], ["time"]),
            "improvement_percentages": A.improvements_vs_raw(approach)}
    for name, df in want.items():
        assert rows(out[name]) == rows(df), name


def test_one_scan_and_empty_table(spark):
    runs = X.runs(spark, SMALL)
    plan = A.general_report(runs, MODELS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert A.general_report(runs.filter(F.lit(False)), MODELS).count() == 0
