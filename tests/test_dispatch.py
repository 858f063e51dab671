"""Request dispatch (U6/U8) against the per-task operators it routes to."""

import json
import re

from pyspark.sql import functions as F

from tests.conftest import SMALL
from verity.operators.dispatch import dispatch
from verity.sources import fixtures as X


def test_dispatch_routes_and_counts(spark):
    req = X.requests(spark, SMALL)
    out = {r.request_id: r for r in dispatch(req).collect()}
    rows = {r.request_id: r for r in req.collect()}
    assert len(out) == len(rows)
    for rid, r in rows.items():
        o = out[rid]
        if r.task_type == "summary" or r.text is None:
            assert o.status == "error" and o.tokens_used == 0 and o.output is None
        elif r.task_type == "sentiment":
            counts = json.loads(o.output)
            assert sum(counts.values()) == len(re.split(r"(?<=[.!?]) +", r.text))
        elif r.task_type == "sql":
            op = (r.operation or "select").lower()
            assert (o.output is None) == (op not in {"select", "insert", "update", "delete", "create", "alter"})
        elif r.task_type == "translation":
            lang = (r.target_language or "german").lower()
            if lang not in {"german", "spanish"}:
                assert o.output.startswith("Unsupported language") and o.status == "success"


def test_report_by_and_models(spark):
    import pytest
    from verity.operators import analytics as A
    from verity.operators.requests import available_models, registry
    from verity.plans import q_analytics as QA
    scored = QA._scored(spark, SMALL)
    by_task = A.report_by(scored, "task_type").collect()
    want = {(r.model, r.task_type, r.approach): r.exact_match_pct for r in QA._by_dim(scored, "task_type").collect()}
    assert {(r.model, r.task_type, r.approach): r.exact_match_pct for r in by_task} == want
    assert A.report_by(scored, "domain").select("domain").distinct().count() <= 10
    with pytest.raises(ValueError):
        A.report_by(scored, "weekday")
    assert [r.model_key for r in available_models(registry(spark, [("m0", "phi3")])).collect()] == ["m0"]
