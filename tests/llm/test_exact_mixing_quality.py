"""Exact dedup, mixing and quality rules against brute force, with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.conftest import SMALL
from verity.llm import exact_dedup, mixing, quality, queries


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    expected = Counter()
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            expected[i, keep, len(ids), hashlib.sha256(body.encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(b.encode()).hexdigest(): 1 for b in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_one_text_over_many_partitions(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id % 1500)) AS text")
    got = exact_dedup.exact_groups(df).toPandas()
    size = got.groupby("text_sha256").doc_id.agg(["size", "min"])
    assert (got.group_size.values == size.loc[got.text_sha256, "size"].values).all()
    assert (got.keep_id.values == size.loc[got.text_sha256, "min"].values).all()
    assert (got.kept == (got.doc_id == got.keep_id)).all()


def test_copies_dropped_and_columns_kept(docs, empty):
    kept = exact_dedup.drop_copies(docs)
    assert kept.schema == docs.schema
    assert kept.count() == docs.selectExpr(r"count(distinct regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' '))").first()[0]
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def test_mixing(docs, rows, empty):
    plan = mixing.mix_plan(docs).toPandas()
    assert len(plan) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * left > share * 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * total[s] if s in capped else weight[s] * left / share for s in order}
    by_size = {total[s]: target[s] for s in order}
    assert len(by_size) == len(order)
    for n, part in plan.groupby("source_size"):
        assert part.target.iloc[0] == pytest.approx(by_size[n])
        assert part.taken.sum() == pytest.approx(by_size[n], abs=1)
    assert (plan.taken <= 3 * plan["size"]).all()
    assert sorted(map(tuple, mixing.mix_plan(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, mixing.mix_plan(docs).collect()), key=str)
    mix = mixing.mixed(docs)
    assert mix.schema == docs.schema
    assert sum(size(r.text) for r in mix.collect()) == plan.taken.sum()
    assert mixing.mixed(empty).count() == 0


def test_mixing_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    rel = con.sql(queries.ORACLES["op3_mixing"])
    assert sorted(map(tuple, queries.op3_mixing(spark, SMALL).select(rel.columns).collect())) == sorted(rel.fetchall())


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, rows, empty):
    more = [(100 + i, t) for i, t in enumerate(["a b c a b c", "x x x x x", "# * $ | <", "one\ntwo\none\n\none", "a b c d a b c e b c d", "é" * 5])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, ["doc_id", "text"]))
    got = quality.quality_verdicts(both).collect()
    expected = Counter((i, *brute_counts(t)) for i, t in [*((r[0], r[1]) for r in rows), *more])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.good_documents(docs).schema == docs.schema
    assert quality.good_documents(empty).count() == 0


def test_votes_are_weighed():
    share, alarm = quality.fit([((True, True, True), 900), ((False, False, True), 60), ((True, True, False), 2), ((None, None, None), 3)])
    good = lambda p: quality.responsibilities(share, alarm, p)[0]
    assert good((True, True, True)) > 0.9 and good((False, False, True)) < 0.1
    assert good((None, None, None)) == pytest.approx(share[0])


def test_each_vote_is_written_out_once(spark, docs):
    """The posterior names each vote some twenty times: written out as often, its code was too long to compile."""
    plan = quality.good_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("n_shouts") <= 8 and 0 < plan.lower().count("power(") <= 4


def test_quality_on_labels(spark):
    got = queries.op10_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    able = got[~got.base_failed]
    assert able[able.quality == 1].kept.mean() > 0.97 and able[able.quality == 0].kept.mean() < 0.3


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"{'word ' * (1 + k)}{k}", "s") for i in (None, 1, 1, 2) for k in range(5)]
    rows += [(i, f"слово {'текст ' * (i % 9)}", "кир") for i in range(300)]
    plans = []
    for some, n in ((rows, 1), (rows[::-1], 5)):
        docs = spark.createDataFrame(some, "doc_id long, text string, source string").repartition(n)
        plans.append(sorted(map(str, mixing.mix_plan(docs, carry=["text"]).select("doc_id", "carried", "size", "taken").collect())))
    assert plans[0] == plans[1]
    sliced = spark.createDataFrame([("слово и текст",)], ["t"]).select(mixing.quality(mixing.F.col("t"))).first()[0]
    assert sliced == 1.0


def test_variety_votes_alike_at_every_size(spark):
    """Few different words are a bad vote in long texts as in short ones, and prose,
    whose vocabulary grows slower than its length, is never voted bad for its length."""
    rows = [(n, k, " ".join(f"word{(i * i + i) % k if i >= k else i}" for i in range(n))) for n in (100, 1_000, 20_000) for k in (int(n**0.5), int(n**0.9))]
    seen = quality.with_features(spark.createDataFrame(rows, "n long, k long, text string"), "text")
    got = {(r.n, r.k): r.v for r in seen.select("n", "k", quality.votes(seen["_f"])["variety"].alias("v")).collect()}
    assert got == {(n, k): k > n**0.7 for n, k, _ in rows}
