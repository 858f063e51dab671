"""H22's scanner against the search pattern it stands for, run by Python."""

import random
import re

from pyspark.sql import functions as F

from verity.functions import records as R

PATTERN = re.compile(r"([A-Za-z\s]+) earns ₹([\d,]+) .+?(?=\. [A-Za-z]|$)")
ITEM = re.compile(r"([\w\s]+) loan of ₹([\d,]+)")
PIECES = [" earns ₹", " earns ₹1 ", "12", ",", " ", ". B", ". ", ".", "\n", "Ann", "x earns ₹5 . C", " spends ₹3", "é", "!", " loan of ₹", "7 loan of ₹8"]


def texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_blocks_equal_the_pattern(spark):
    given = sorted(set(texts(6000)))
    df = spark.createDataFrame([(t,) for t in given], "t string").repartition(8)
    got = {r.t: [(b["name"], b["block"]) for b in r.found] for r in df.select("t", R.user_blocks("t").alias("found")).collect()}
    want = {t: [(m.group(1), m.group(0)) for m in PATTERN.finditer(t)] for t in given}
    assert sum(map(bool, want.values())) > 500
    assert [(t, got[t], want[t]) for t in given if got[t] != want[t]][:3] == []


def test_items_equal_the_pattern(spark):
    given = sorted(set(texts(3000, seed=9)))
    df = spark.createDataFrame([(t,) for t in given], "t string").repartition(8)
    got = {r.t: list(zip(r.a, r.b)) for r in df.select("t", *[F.regexp_extract_all("t", F.lit(R.LOAN), g).alias(n) for g, n in ((1, "a"), (2, "b"))]).collect()}
    assert [t for t in given if got[t] != ITEM.findall(t)] == []


def test_null_empty_and_long_runs(spark):
    rows = [(None,), ("",), ("word " * 200_000 + "earns",), ("word " * 50_000 + "Ann earns ₹5 a year, spends ₹2",)]
    got = spark.createDataFrame(rows, "t string").select(R.user_blocks("t").alias("f")).collect()
    assert got[0].f is None and got[1].f == [] and got[2].f == [] and len(got[3].f) == 1
