"""Schemas as data (H23) against hand-made cases; each outcome of the requests query occurs."""

from pyspark.sql import functions as F

from tests.conftest import SMALL
from verity.operators import json_schema as J
from verity.operators.records import process_financial_data
from verity.plans.q_financial import u7_financial_requests

TEXT = "Ann earns ₹50 a day, spends ₹2, has a car loan of ₹9"


def checked(spark, rows):
    df = spark.createDataFrame(rows, "id int, date string, text string, `my.schema` string, rules string, violations2 string")
    return {r.id: r for r in process_financial_data(df, schema="my.schema").collect()}


def test_three_schemas_in_one_table(spark):
    low = '{"properties":{"users":{"items":{"properties":{"salary":{"maximum":49},"loans":{"additionalProperties":{"minimum":10}}}}}}}'
    kind = '{"required":["users","author"],"properties":{"users":{"type":"object"},"date":{"type":"string"}}}'
    got = checked(spark, [(1, "d", TEXT, low, None, None), (2, "d", TEXT, kind, None, None), (3, "d", TEXT, "{}", None, None),
                          (4, "d", TEXT, "{", None, None), (5, "d", TEXT, None, None, None), (6, None, TEXT, "{}", None, None),
                          (7, "d", None, "{}", None, None), (8, "d", "", "{}", None, None), (8, "d", "", "{}", None, None)])
    assert got[1].violations == ["$.users[0].loans.has a car is below its minimum", "$.users[0].salary is above its maximum"]
    assert got[2].violations == ["$.users is not of type object", "$: 'author' is a required property"]
    assert [got[i].code for i in range(1, 9)] == [400, 400, 200, 500, 400, 400, 400, 200]
    assert got[3].violations == [] and got[4].violations is None and "'my.schema'" in got[5].error


def test_repeated_and_no_requests(spark):
    df = spark.createDataFrame([(1, "d", TEXT, "{}")] * 40, "id int, date string, text string, schema string")
    assert process_financial_data(df, schema="schema").count() == 40
    assert process_financial_data(df.limit(0), schema="schema").count() == 0
    assert J.with_rules(df, "schema").select(F.count_if(F.size("rules") == 1)).first()[0] == 40


def test_every_outcome_occurs(spark):
    rows = u7_financial_requests(spark, SMALL).collect()
    assert {r.code for r in rows} == {200, 400, 500} and {r.n_users for r in rows} >= {None, 0, 1, 2, 3}
    said = " ".join(r.violations or "" for r in rows)
    for part in ("'pension'", "'date'", "'users'", "below its minimum", "above its maximum", "not of type string", ".loans."):
        assert part in said, part
