"""Every stage against a plain version of its rule, on what its predecessor kept."""

import re
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_exact_mixing_quality import norm
from verity.llm import mixing, quality
from verity.llm.shared import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(P.STAGES)
    good = written(stage["quality_rules"](spark, docs, SF), "t")
    verdict = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, k in verdict.items() if k}
    one = written(stage["exact_dedup"](spark, good, SF), "t")
    least = {}
    for r in good.collect():
        least[norm(r.text)] = min(r.doc_id, least.get(norm(r.text), r.doc_id))
    assert sorted(r.doc_id for r in one.collect()) == sorted(least.values())
    near = written(stage["near_dedup"](spark, one, SF), "t")
    assert near.columns == docs.columns and 0 < near.count() <= one.count()
    mix = written(stage["mixing"](spark, near, SF), "t")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(size(r.text) for r in mix.collect()) == mixing.mix_plan(near).agg({"taken": "sum"}).first()[0]
    pieces = stage["packing"](spark, mix, SF).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    expected = Counter()
    for r in mix.collect():
        expected[r.doc_id] += len(t.encode(r.text, add_special_tokens=False).ids) + 1
    assert pieces.groupby("doc_id").length.sum().to_dict() == dict(expected)


def test_run(spark):
    assert P.run(spark, SF).count() > 0 and P.ORACLE_SQL is None


def test_odd_rows_and_empty_table(spark, docs, empty):
    packed = P.run_stages(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} <= {r.doc_id for r in docs.collect()}
    assert P.run_stages(spark, empty, SF).count() == 0


def test_stages_keep_other_columns(spark, rows):
    import datetime

    from pyspark.sql import functions as F

    when = datetime.datetime(2024, 5, 1, 12, 0, 0, 123456)
    docs = spark.createDataFrame([(*r[:5], when, {datetime.date(2024, 1, 1): 2}, "q") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, at timestamp, by map<date,int>, `node.id` string").repartition(2)
    for name, stage in P.STAGES[:4]:
        kept = written(stage(spark, docs, SF), "t")
        assert kept.columns == docs.columns and kept.count(), name
        assert {(r.at, tuple(r.by.items()), r["node.id"]) for r in kept.select("at", "by", F.col("`node.id`")).collect()} == {(when, ((datetime.date(2024, 1, 1), 2),), "q")}
