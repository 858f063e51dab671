"""Unit goldens for the SQL scorers (hand-traced cases) and a brute-force
check of BLEU / clause scoring against a plain-Python model of the rules."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verity.functions import sqltext as S
from verity.operators import sqlbench as B


def one(spark, col, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(col).first()[0]


@pytest.mark.parametrize("q,expected", [
    ("a>=5", "a > = 5"), ("a<>5", "a < > 5"), ("a!=5", "a! = 5"),
    ("SELECT  *\nFROM t;", "select * from t"), ("x ;", "x "),
])
def test_normalize_basic(spark, q, expected):
    assert one(spark, S.normalize_basic("c0"), q) == expected


@pytest.mark.parametrize("q,expected", [
    ("", ""), ("x ;", "x "), ("SELECT COUNT (*) AS n FROM `t` INNER  JOIN u", "select count(*) as n from t join u"),
    ("SELECT a AS b FROM t GROUP   BY a;", "select a b from t group by a"),
    ('select "A" from t', "select a from t"),
])
def test_normalize_advanced(spark, q, expected):
    assert one(spark, S.normalize_advanced("c0"), q) == expected


def test_validity_substring_rules(spark):
    assert one(spark, S.is_valid_sql("c0"), "SELECT updated_at FROM t;") is False
    assert one(spark, S.is_valid_sql("c0"), "SELECT a FROM t;") is True
    assert one(spark, S.is_valid_sql("c0"), "SELECT a FROM t") is False
    assert one(spark, S.clean_sql("c0"), "```sql\nSELECT 1;\n```") == "SELECT 1;"


def test_operation_inference(spark):
    assert one(spark, S.infer_operation("c0"), "  update t set a=1") == "update"
    assert one(spark, S.infer_operation("c0"), "WITH x AS (SELECT 1) SELECT * FROM x") == "select"


# --- brute force model of the scores (plain Python, small inputs) -----------
def py_norm_basic(q):
    q = re.sub(r"\s+", " ", q.lower()).strip()
    q = re.sub(r";$", "", q)
    for op in S.OPERATORS:
        q = re.sub(r"\s*" + re.escape(op) + r"\s*", f" {op} ", q)
    return q


def py_bleu(gen, ref):
    g, r = gen.split(), ref.split()
    nums, dens = [], []
    for n in range(1, 5):
        cg = Counter(tuple(g[i:i + n]) for i in range(len(g) - n + 1))
        cr = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        nums.append(sum(min(c, cr[k]) for k, c in cg.items()))
        dens.append(max(1, sum(cg.values())))
    if nums[0] == 0:
        return 0.0
    c, rl = len(g), len(r)
    bp = 1.0 if c > rl else (0.0 if c == 0 else math.exp(1 - rl / c))
    ps = [nu / de if nu else 2.2250738585072014e-308 for nu, de in zip(nums, dens)]
    return bp * math.exp(math.fsum(0.25 * math.log(p) for p in ps))


PAIRS = [
    ("SELECT a, b FROM t WHERE x = 1;", "SELECT a, b FROM t WHERE x = 1;"),
    ("select a from t", "SELECT a, b FROM t WHERE x = 1;"),
    ("SELECT 1;", "SELECT p_name FROM part WHERE p_size > 3;"),
    ("", "SELECT a FROM t;"),
    ("SELECT a a a a FROM t t", "SELECT a a FROM t"),
    ("SELECT x", "SELECT x"),
]


@pytest.mark.parametrize("gen,ref", PAIRS)
def test_bleu_matches_brute_force(spark, gen, ref):
    got = one(spark, S.semantic_similarity("c0", "c1"), gen, ref)
    want = py_bleu(py_norm_basic(gen), py_norm_basic(ref))
    assert got == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_staged_scores_equal_inline_and_properties(spark):
    df = spark.createDataFrame(PAIRS, "generated string, reference string")
    staged = B.score_pairs(df).select("generated", "reference", "component_match", "semantic_similarity",
                                      "exact_match", "execution_match", "structural_similarity").collect()
    inline = df.select(
        S.component_match(S.normalize_advanced("generated"), S.normalize_advanced("reference")).alias("c"),
        S.semantic_similarity("generated", "reference").alias("s")).collect()
    for a, b in zip(staged, inline):
        assert a.component_match == pytest.approx(b.c)
        assert a.semantic_similarity == pytest.approx(b.s, abs=1e-300)
        for v in (a.component_match, a.semantic_similarity, a.exact_match, a.structural_similarity):
            assert 0.0 <= v <= 1.0
    same = B.score_pairs(spark.createDataFrame([(r, r) for _, r in PAIRS], "generated string, reference string"))
    for r in same.collect():
        assert r.exact_match == 1.0 and r.execution_match == 1.0 and r.structural_similarity == 1.0


def test_no_python_udf_in_scoring_plan(spark):
    from verity.sources import fixtures as X
    plan = B.score_pairs(X.sql_pairs(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_token_counter_falls_back_without_vocabulary(spark):
    from verity.functions.tokens import bpe_available, token_counter
    df = spark.createDataFrame([("select a from t",)], "q string")
    n = df.select(token_counter("q", prefer_bpe=True)).first()[0]
    assert n == 4 if not bpe_available() else n > 0


def test_distinct_pair_scoring_equals_plain(spark):
    df = spark.createDataFrame([*PAIRS, *PAIRS[:3], (None, PAIRS[0][1])], "generated string, reference string")
    columns = ["generated", "reference", *B.SCORE_OUTPUT]
    rows = lambda scored: sorted(map(repr, scored.select(columns).collect()))
    assert rows(B.score_distinct_pairs(df)) == rows(B.score_pairs(df))


def test_prepared_references_score_alike_and_are_normalised_once(spark):
    """A reference with many responses is read once, below the join."""
    queries = ["SELECT a AS b, COUNT (*) FROM t LEFT  JOIN u ON a = b WHERE x >= 1 GROUP  BY a;", "select a, a, a from t, t",
               "as as as b", "ſelect `a` from t lımit 5", "", None]
    refs = spark.createDataFrame(list(enumerate(queries)), "k int, reference string")
    pairs = refs.crossJoin(spark.createDataFrame([(q,) for q in queries], "generated string"))
    alone = B.score_pairs(pairs)
    gens = spark.createDataFrame([(k, q) for k in range(len(queries)) for q in queries], "k int, generated string")
    prepared = B.score_pairs(gens.join(B.reference_forms(refs).hint("merge"), "k"), prepared=True)
    columns = sorted(alone.columns)
    assert sorted(prepared.columns) == columns
    assert sorted(map(repr, alone.select(columns).collect())) == sorted(map(repr, prepared.select(columns).collect()))


@pytest.mark.parametrize("q,expected", [
    ("a as b as c", "a b as c"), ("x as as as y", "x as as y"), ("as as b", "as b"), ("left\t join x", "left join x"),
    ("a ` ` as ``b", "a b"), ("sum  (x) xsum (y)", "sum(x) xsum (y)"), ("beginner join t", "beginner join t"),
])
def test_normal_form_of_odd_spacing(spark, q, expected):
    assert one(spark, S.normalize_advanced("c0"), q) == expected


def test_sides_are_lowered_and_spaced_once(spark):
    """Both normal forms and the words' number of a side come from one plain form, the same for ASCII and other text."""
    pieces = ["SELECT", " ", "\t", "\n", "\x0b", "\f", "\r", " ", " ", "\x85", "\x1c", ";", "a=1", "É", "K", "`x`", "", "count ("]
    draw = random.Random(3)
    texts = [None, "", " ", ";", " ; ", *("".join(draw.choice(pieces[:7] + pieces[10:13] if i % 2 else pieces) for _ in range(draw.randrange(9))) for i in range(400))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = S.strip(S.single_spaced(F.lower("t")))
    got = df.select(S.plain_form("t").eqNullSafe(whole).alias("same"), F.size(S.single_spaced_words(S.plain_form("t"))).cast("bigint").eqNullSafe(S.word_count("t")).alias("count"))
    assert got.where("not same or not count").count() == 0
    pairs = df.select(F.col("t").alias("generated"), F.lit("select 1").alias("reference"))
    plan = B.score_pairs(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[\\s&&[^ ]]") == 1  # only the branch for text that is not ASCII


def _odd_forms(count):
    pieces = ["select", " ", " ", " ", "from", "where", "group", "by", "having", "order", "limit", "5", "a", "b", ",", ";", "*", "(", ")", "count",
              "sum (", "as", "inner", "join", "left", "`", '"', ".", "_", "é", "ſ", "K", "\t", "distinct", "max(", "Union", "x́", "\x85"]
    draw = random.Random(9)
    ascii_pieces = [p for p in pieces if p.isascii()]
    return ["".join(draw.choice(ascii_pieces if i % 2 else pieces) for _ in range(draw.randrange(30))) for i in range(count)]


def test_guarded_steps_equal_the_plain_patterns(spark):
    """Steps, flags and clauses tried only where a text can have them give what the patterns alone give."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(_odd_forms(1500))], "i int, t string")
    df = df.withColumn("p", S.plain_form("t")).withColumn("n", F.col("p"))
    for step in S.ADVANCED_STEPS:
        df = df.withColumn("n", S.advanced_step("n", step))
    df = df.withColumn("n", F.coalesce("n", F.lit("")))
    flags = df.select("n", S.structure_flags("n").alias("f")).collect()
    clauses = df.select("n", *[S.clause_text("n", pat).alias(name) for name, pat, _ in S.CLAUSES]).collect()
    patterns = df.select(
        "n", S.advanced_of("p").alias("whole"), *[F.col("n").rlike(S.U + pat).alias(f"f{i}") for i, pat in enumerate(S.STRUCTURES)],
        *[S.strip(F.regexp_extract("n", "(?iU)" + pat, 1)).alias(name) for name, pat, _ in S.CLAUSES]).collect()
    for f, c, want in zip(flags, clauses, patterns, strict=True):
        assert f.n == c.n == want.n == want.whole
        assert f.f == sum(want[f"f{i}"] << i for i in range(len(S.STRUCTURES))), f.n
        assert [c[name] for name, _, _ in S.CLAUSES] == [want[name] for name, _, _ in S.CLAUSES], f.n
    assert sum(c.select_cols != "" for c in clauses) > 20 and len({f.f for f in flags}) > 50


def test_clause_scores_by_sets(spark):
    """Words and items that repeat count once, equal texts share all."""
    texts = ["a", "a, a", "a, b", "b,a, c", "*", "a b a", "b  a", "a,", "", "a ,b"]
    df = spark.createDataFrame([(g, r) for g in texts for r in texts if r], "g string, r string")
    got = df.select("g", "r", S.clause_score("select_cols", F.col("g"), F.col("r")).alias("cols"),
                    S.clause_score("where_clause", F.col("g"), F.col("r"), S.clause_words("r")).alias("words"))

    def share(a, b):
        return len(set(a) & set(b)) / len(set(b))

    for row in got.collect():
        words = share(row.g.split(" ") if row.g else [], row.r.split(" "))
        items = share(re.split(", *", row.g), re.split(", *", row.r))
        assert row.words == words and row.cols == (words if "*" in row.g + row.r else items), row
