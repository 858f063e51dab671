"""Goldens for text functions and a financial report worked out by hand."""

import os
import re

import pytest
from pyspark.sql import functions as F

from verity.functions import text as T
from verity.operators.records import process_financial_data

# Worked out by hand. A sentence end closes a block, a comma closes an item's name, and a
# user whose sentence has no "earns" opens no block.
REPORT = (
    "Notes of the 3rd of May. Mira Holt earns ₹9,40,000 yearly, spends ₹2,10,000 and invested ₹75,000 in Tea, "
    "with savings of ₹8,000 in a tin. She later sold it. Jon Abe has a wage of ₹5. Ole Berg earns ₹61,000, spends ₹7. "
    "Una Roy earns ₹88 a day, spends ₹80, owes a boat loan of ₹450, and a shop debt of ₹12"
)


def test_report_worked_by_hand(spark):
    df = spark.createDataFrame([("2023-05-03", REPORT)], "date string, text string")
    r = process_financial_data(df).first()
    assert (r.status, r.code) == ("success", 200)
    users = [u.asDict() for u in r.users]
    # "61,000," is an amount too: its run of digits and commas ends at the blank.
    assert [(u["name"], u["salary"], u["expenses"]) for u in users] == [("Mira Holt", 940000, 210000), ("Ole Berg", 61000, 7), ("Una Roy", 88, 80)]
    assert users[0]["investments"] == {"tea": 75000} and users[0]["savings"] == 8000
    assert users[2]["loans"] == {"owes a boat": 450} and users[2]["debts"] == {"and a shop": 12}
    # The words in, and out: 3, 14 for each of 3 users, a blank in each name, 1 + 3 + 3 more for the filled maps.
    assert r.tokens_used == len(REPORT.split()) + 3 + 3 * 14 + 3 + 1 + 3 + 3


def test_missing_spends_fails_request(spark):
    df = spark.createDataFrame([("2025-01-01", "Raj earns ₹100 a year")], "date string, text string")
    r = process_financial_data(df).first()
    assert r.code == 500 and r.tokens_used == 0


def py_sentences(t):
    return re.split(r"(?<=[.!?]) +", t)


@pytest.mark.parametrize("t", ["", "One. Two!  Three? four", "a.b. c.", "end. "])
def test_sentence_split_matches_python(spark, t):
    got = spark.createDataFrame([(t,)], "t string").select(T.split_sentences("t")).first()[0]
    assert got == py_sentences(t)


def test_text_goldens(spark):
    df = spark.createDataFrame([("Hallo",)], "t string")
    assert df.select(T.clean_translation("t")).first()[0] == ""
    df = spark.createDataFrame([("It is not positive but negative",)], "t string")
    assert df.select(T.sentiment_label("t")).first()[0] == "positive"
    poem = "a\n\nb\nc\nd\ne\nf"
    df = spark.createDataFrame([(poem,)], "t string").select(T.nonblank_lines("t").alias("l"))
    r = df.select(F.size("l"), T.first_lines("l")).first()
    assert r[0] == 6 and r[1] == "a\nb\nc\nd\ne"
    df = spark.createDataFrame([(["Hallo Welt", "Gut!", "x"],)], "p array<string>")
    assert df.select(T.reassemble("p")).first()[0] == "Hallo Welt.Gut!x."


def test_item_lists_of_a_block_are_searched_once(spark):
    """keys and values of an item map were searched again for every key of the map."""
    from verity.functions import records as R

    record = str(R.user_record(F.col("block"), F.col("name")))
    assert record.count("regexp_extract_all(") == 7  # savings, and names and amounts of three lists
    rows = [("A", "A earns ₹1 a, spends ₹2, a car loan of ₹3, a car loan of ₹4 and b loan of ₹5"), ("B", "B earns ₹1 x"), ("C", None)]
    got = spark.createDataFrame(rows, "name string, block string").select("name", R.user_record(F.col("block"), F.col("name")).alias("u")).collect()
    loans = {r["name"]: r["u"]["loans"] for r in got}
    assert loans == {"A": {"a car": 4, "and b": 5}, "B": {}, "C": None}
