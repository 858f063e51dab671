"""Registered text-to-SQL queries: scorers (H1-H11, X1, X2, H29), the
benchmark job (U9 = W1 -> J3 -> P6 -> H9 -> A1) and its derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verity.functions import sqltext as S
from verity.operators import sqlbench as B
from verity.operators.partitioning import spread
from verity.plans import oracle as O
from verity.plans.catalog import register
from verity.sources import fixtures as X

SUMMARY_COLS = "model, complexity, approach, time, tokens, exact_match, execution_match, component_match, " \
               "token_efficiency, semantic_similarity, sample_count"


def _summary(spark, sf_dir, num_samples=None, levels=X.COMPLEXITY_LEVELS):
    return B.run_sql_benchmark(
        spark, X.corpus(spark, sf_dir), X.sql_responses(spark, sf_dir), X.MODELS, num_samples, levels
    )


@register(
    "a1_sql_benchmark_summary",
    f"""WITH {O.SQL_RESPONSES},
{O.key_grid_sql()},
pairs AS (
  SELECT r.*, c.complexity, c.query AS reference
  FROM sql_responses r JOIN corpus c USING (sample_id)
  WHERE r.error IS NULL),
{O.scored_pairs_sql('pairs', 'response', 'reference')},
{O.summary_sql()}
SELECT {SUMMARY_COLS} FROM summary""",
)
def a1_sql_benchmark_summary(spark, sf_dir):
    """U9/A1 over every sample of the corpus and every recorded response."""
    return _summary(spark, sf_dir)


_PAIR_COLS = ("sample_id", "approach", "exact_match", "execution_match", "component_match",
              "structural_similarity", "token_efficiency", "semantic_similarity")


@register(
    "h9_pair_scores",
    f"""WITH {O.SQL_PAIRS},
{O.scored_pairs_sql('sql_pairs', 'generated', 'reference')}
SELECT sample_id, approach, exact_match, execution_match, round(component_match, 6) AS component_match,
       round(structural_similarity, 6) AS structural_similarity, round(token_efficiency, 6) AS token_efficiency,
       round(semantic_similarity, 6) AS semantic_similarity
FROM scored""",
)
def h9_pair_scores(spark, sf_dir):
    """H9 (with H4-H8) for every (generated, reference) pair."""
    s = B.score_pairs(X.sql_pairs(spark, sf_dir, B.reference_forms), prepared=True)
    return s.select(
        "sample_id", "approach", "exact_match", "execution_match",
        *[B.r6(c).alias(c) for c in _PAIR_COLS[4:]],
    )


# --- per-pair scorer queries (sql_pairs fixture: corpus x 4 approaches) ------
_PAIRS = f"WITH {O.SQL_PAIRS}"


@register(
    "h1_normalize_basic",
    f"""{_PAIRS}
SELECT sample_id, approach, {O.norm_basic('generated')} AS gen_basic, {O.norm_basic('reference')} AS ref_basic
FROM sql_pairs""",
)
def h1_normalize_basic(spark, sf_dir):
    p = X.sql_pairs(spark, sf_dir)
    return p.select("sample_id", "approach", S.normalize_basic("generated").alias("gen_basic"),
                    S.normalize_basic("reference").alias("ref_basic"))


@register(
    "h2_exact_match_basic",
    f"""{_PAIRS}
SELECT sample_id, approach, CAST({O.norm_basic('generated')} = {O.norm_basic('reference')} AS DOUBLE) AS exact_basic
FROM sql_pairs""",
)
def h2_exact_match_basic(spark, sf_dir):
    p = X.sql_pairs(spark, sf_dir)
    return p.select("sample_id", "approach", S.exact_match_basic("generated", "reference").alias("exact_basic"))


@register(
    "h3_component_match_basic",
    f"""{_PAIRS},
n AS (SELECT sample_id, approach, {O.norm_basic('generated')} AS gb, {O.norm_basic('reference')} AS rb FROM sql_pairs)
SELECT sample_id, approach, round({O.component_match_basic('gb', 'rb')}, 6) AS component_basic FROM n""",
)
def h3_component_match_basic(spark, sf_dir):
    p = X.sql_pairs(spark, sf_dir).select(
        "sample_id", "approach", S.normalize_basic("generated").alias("gb"), S.normalize_basic("reference").alias("rb"))
    return p.select("sample_id", "approach", B.r6(S.component_match_basic("gb", "rb")).alias("component_basic"))


@register(
    "h6_normalize_advanced",
    f"""{_PAIRS}
SELECT sample_id, approach, {O.norm_adv('generated')} AS gen_norm, {O.norm_adv('reference')} AS ref_norm,
       CAST({O.norm_adv('generated')} = {O.norm_adv('reference')} AS DOUBLE) AS exact_match
FROM sql_pairs""",
)
def h6_normalize_advanced(spark, sf_dir):
    p = X.sql_pairs(spark, sf_dir).select(
        "sample_id", "approach", S.normalize_advanced("generated").alias("gen_norm"),
        S.normalize_advanced("reference").alias("ref_norm"))
    return p.withColumn("exact_match", (F.col("gen_norm") == F.col("ref_norm")).cast("double"))


_CLAUSE_SQL = " UNION ALL ".join(
    f"SELECT sample_id, approach, {O.q(name)} AS clause, {O.clause('gen_norm', pat)} AS gen_clause, "
    f"{O.clause('ref_norm', pat)} AS ref_clause, CASE WHEN {O.clause('ref_norm', pat)} <> '' THEN "
    f"round({O.clause_score(name, O.clause('gen_norm', pat), O.clause('ref_norm', pat))}, 6) END AS score FROM n"
    for name, pat, _ in S.CLAUSES
)


@register(
    "h7_clause_scores",
    f"""{_PAIRS},
n AS (SELECT sample_id, approach, {O.norm_adv('generated')} AS gen_norm, {O.norm_adv('reference')} AS ref_norm
      FROM sql_pairs)
{_CLAUSE_SQL}""",
)
def h7_clause_scores(spark, sf_dir):
    """H7 per clause: extracted texts and overlap score (feeds A19)."""
    p = X.sql_pairs(spark, sf_dir).select(
        "sample_id", "approach", S.normalize_advanced("generated").alias("gen_norm"),
        S.normalize_advanced("reference").alias("ref_norm"))
    items = []
    for name, pat, _ in S.CLAUSES:
        g, r = S.clause_text("gen_norm", pat), S.clause_text("ref_norm", pat)
        items.append(F.struct(F.lit(name).alias("clause"), g.alias("gen_clause"), r.alias("ref_clause")))
    e = p.select("sample_id", "approach", F.explode_outer(F.array(*items)).alias("c")).select(
        "sample_id", "approach", "c.*")
    score = F
    for name, _, _ in S.CLAUSES:
        score = score.when((F.col("clause") == name) & (F.col("ref_clause") != ""),
                           S.clause_score(name, F.col("gen_clause"), F.col("ref_clause")))
    return e.withColumn("score", B.r6(score))


@register(
    "h8_structural_similarity",
    f"""{_PAIRS},
n AS (SELECT sample_id, approach, {O.norm_adv('generated')} AS gen_norm, {O.norm_adv('reference')} AS ref_norm
      FROM sql_pairs)
SELECT sample_id, approach, round({O.structural()}, 6) AS structural_similarity FROM n""",
)
def h8_structural_similarity(spark, sf_dir):
    p = X.sql_pairs(spark, sf_dir).select(
        "sample_id", "approach", S.normalize_advanced("generated").alias("gen_norm"),
        S.normalize_advanced("reference").alias("ref_norm"))
    return p.select("sample_id", "approach",
                    B.r6(S.structural_similarity("gen_norm", "ref_norm")).alias("structural_similarity"))


@register(
    "x1_token_overlap",
    f"""{_PAIRS},
n AS (SELECT sample_id, approach, {O.norm_adv('generated')} AS gen_norm, {O.norm_adv('reference')} AS ref_norm
      FROM sql_pairs),
t AS (SELECT sample_id, approach,
             list_distinct({O.words(O.rre('gen_norm', '[(),]', ' '))}) AS g,
             list_distinct({O.words(O.rre('ref_norm', '[(),]', ' '))}) AS r FROM n)
SELECT sample_id, approach, round(len(list_intersect(g, r)) / greatest(len(r), 1), 6) AS token_overlap FROM t""",
)
def x1_token_overlap(spark, sf_dir):
    p = X.sql_pairs(spark, sf_dir).select(
        "sample_id", "approach", S.normalize_advanced("generated").alias("gen_norm"),
        S.normalize_advanced("reference").alias("ref_norm"))
    return p.select("sample_id", "approach", B.r6(S.token_overlap("gen_norm", "ref_norm")).alias("token_overlap"))


@register(
    "x2_jaccard_similarity",
    f"""{_PAIRS},
t AS (SELECT sample_id, approach, {O.words(O.norm_basic('generated'))} AS gt,
             {O.words(O.norm_basic('reference'))} AS rt FROM sql_pairs)
SELECT sample_id, approach, round({O.jaccard_from('gt', 'rt')}, 6) AS jaccard FROM t""",
)
def x2_jaccard_similarity(spark, sf_dir):
    """X2 over staged token columns (each token array built once per row)."""
    p = X.sql_pairs(spark, sf_dir).select(
        "sample_id", "approach", S.single_spaced_words(S.normalize_basic("generated")).alias("gt"),
        S.single_spaced_words(S.normalize_basic("reference")).alias("rt"))
    return p.select("sample_id", "approach", B.r6(S.jaccard("gt", "rt")).alias("jaccard"))


_VALID_SQL = (
    f"(ends_with({O.strip('generated')}, ';') AND ("
    + " OR ".join(f"contains(upper(generated), {O.q(op.upper())})" for op in S.SQL_OPERATIONS)
    + ") AND (NOT contains(upper(generated), 'CREATE TABLE') OR contains(generated, '('))"
    " AND (NOT (contains(upper(generated), 'UPDATE') OR contains(upper(generated), 'DELETE'))"
    " OR contains(upper(generated), 'WHERE')))"
)
_CLEAN_SQL = O.strip(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(generated, '^```sql\\n', ''), '^```\\n', ''), "
    "'\\n```$', ''), '\\n', ' ', 'g')"
).replace("\\n", "' || chr(10) || '")


@register(
    "h10_h11_validate_clean_sql",
    f"""{_PAIRS}
SELECT sample_id, approach, {_VALID_SQL} AS is_valid, {_CLEAN_SQL} AS cleaned FROM sql_pairs""",
)
def h10_h11_validate_clean_sql(spark, sf_dir):
    """H10 validity check and H11 cleaning of every generated answer."""
    p = X.sql_pairs(spark, sf_dir)
    return p.select("sample_id", "approach", S.is_valid_sql("generated").alias("is_valid"),
                    S.clean_sql("generated").alias("cleaned"))


@register(
    "p9_infer_operation",
    f"""WITH {O.CORPUS}
SELECT sample_id, CASE WHEN starts_with(upper({O.strip('query')}), 'SELECT') THEN 'select'
  WHEN starts_with(upper({O.strip('query')}), 'INSERT') THEN 'insert'
  WHEN starts_with(upper({O.strip('query')}), 'UPDATE') THEN 'update'
  WHEN starts_with(upper({O.strip('query')}), 'DELETE') THEN 'delete'
  WHEN starts_with(upper({O.strip('query')}), 'CREATE') THEN 'create'
  WHEN starts_with(upper({O.strip('query')}), 'ALTER') THEN 'alter' ELSE 'select' END AS operation
FROM corpus""",
)
def p9_infer_operation(spark, sf_dir):
    c = X.corpus(spark, sf_dir)
    return c.select("sample_id", S.infer_operation("query").alias("operation"))


# --- prompts (P12-P16) ------------------------------------------------------
from verity.functions import prompts as PR  # noqa: E402
from verity.operators import analytics as AN  # noqa: E402


def _sql_fill(template: str, **exprs) -> str:
    """DuckDB concatenation for a ``{name}`` template (null -> '')."""
    out, rest = [], template
    while "{" in rest:
        i, j = rest.index("{"), rest.index("}", rest.index("{"))
        name = rest[i + 1:j]
        if name not in exprs:
            out.append(O.q(rest[:j + 1]))
            rest = rest[j + 1:]
            continue
        out += [O.q(rest[:i]), f"coalesce(CAST({exprs[name]} AS VARCHAR), '')"]
        rest = rest[j + 1:]
    out.append(O.q(rest))
    return "(" + " || ".join(out) + ")"


_OPS_SQL = "CASE lower(op) " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in PR.OPERATION_SENTENCES) + " END"
_OP_OF = ("CASE " + " ".join(f"WHEN starts_with(upper({O.strip('query')}), {O.q(o.upper())}) THEN {O.q(o)}"
                            for o in S.SQL_OPERATIONS) + " ELSE 'select' END")
_PROMPTS_SQL = {
    "raw": _sql_fill(PR.SQL_RAW, table_info="table_info", question="question"),
    "fine_tuned": _sql_fill(PR.SQL_FINE_TUNED, table_info="table_info", question="question"),
    "few_shot": f"({O.q(PR.SQL_FEW_SHOT_HEAD)} || coalesce(ex.examples, '') || "
                f"{_sql_fill(PR.SQL_FEW_SHOT_TAIL, table_info='table_info', question='question')})",
    "controlled": _sql_fill(PR.CONTROLLED, operation_sentence=_OPS_SQL, table_info="table_info",
                            question="question"),
}


# The samples with the few-shot examples beside them, then their prompts; after ``corpus``.
PROMPTS_SQL = f"""firsts AS (SELECT *, list_position({O.lst(X.COMPLEXITY_LEVELS)}, complexity) AS lvl FROM (
  SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY ordinal) AS rn FROM corpus) WHERE rn = 1
  AND complexity IN {tuple(X.COMPLEXITY_LEVELS)}),
picked AS (SELECT * FROM firsts ORDER BY lvl LIMIT 3),
ex AS (SELECT string_agg({_sql_fill(PR.SQL_FEW_SHOT_EXAMPLE, table_info='table_info', question='question', query='query')},
       '' ORDER BY lvl) AS examples FROM picked),
c AS (SELECT corpus.*, {_OP_OF} AS op FROM corpus),
prompts AS ({' UNION ALL '.join(f"SELECT sample_id, '{a}' AS approach, {e} AS prompt FROM c CROSS JOIN ex" for a, e in _PROMPTS_SQL.items())})"""


def sql_prompts(spark, sf_dir):
    """P12-P15 (+W3): every sample's prompt under each SQL approach. The few-shot
    block is a one-row table (three examples), broadcast against the corpus."""
    c = X.corpus(spark, sf_dir)
    block = PR.few_shot_block(AN.few_shot_examples(c))
    j = spread(c.select("sample_id", "table_info", "question", "query")).withColumn("op", S.infer_operation("query")).crossJoin(F.broadcast(block))
    prompts = F.array(*[F.struct(
        F.lit(a).alias("approach"),
        PR.sql_prompt(a, F.col("table_info"), F.col("question"), F.col("op"), F.col("examples")).alias("prompt"))
        for a in X.APPROACHES])
    return j.select("sample_id", F.explode(prompts).alias("p")).select("sample_id", "p.approach", "p.prompt")


@register(
    "p12_p15_sql_prompts",
    f"""WITH {O.CORPUS}, {PROMPTS_SQL}
SELECT sample_id, approach, sha256(prompt) AS prompt_sha, {O.wc('prompt')} AS prompt_words FROM prompts""",
)
def p12_p15_sql_prompts(spark, sf_dir):
    """Each prompt as the replay key (SHA-256) and its word count."""
    return sql_prompts(spark, sf_dir).select(
        "sample_id", "approach", F.sha2("prompt", 256).alias("prompt_sha"), S.word_count(F.col("prompt")).alias("prompt_words"))


def _task_prompt_sql(table, approach):
    arms = " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in table)
    lang = "CASE WHEN lower(coalesce(target_language, 'german')) IN ('german', 'spanish') " \
           "THEN lower(coalesce(target_language, 'german')) ELSE 'german' END"
    key = f"CASE WHEN task_type = 'translation' THEN 'translation:' || {lang} ELSE task_type END"
    return (f"SELECT request_id, '{approach}' AS approach, sha256((CASE {key} {arms} END) || '{' ' if approach == 'few_shot' else ''}' || coalesce(text, '')) "
            f"AS prompt_sha FROM requests")


@register(
    "p16_task_prompts",
    f"WITH {O.REQUESTS}\n{_task_prompt_sql(PR.TASK_RAW, 'raw')} UNION ALL "
    f"{_task_prompt_sql(PR.TASK_FEW_SHOT, 'few_shot')} UNION ALL {_task_prompt_sql(PR.TASK_FINE_TUNED, 'fine_tuned')}",
)
def p16_task_prompts(spark, sf_dir):
    """P12-P14/P16 general-benchmark prompts per request and approach, in one
    scan (null for tasks without a prompt, e.g. poem)."""
    prompts = F.array(*[F.struct(
        F.lit(a).alias("approach"),
        F.sha2(PR.task_prompt(a, F.col("task_type"), F.col("text"), F.col("target_language")), 256).alias("prompt_sha"))
        for a in PR.TASK_PROMPTS])
    return X.requests(spark, sf_dir).select("request_id", F.explode(prompts).alias("p")).select("request_id", "p.*")


@register(
    "h29_explain_pair",
    f"""{_PAIRS},
{O.scored_pairs_sql('sql_pairs', 'generated', 'reference')}
SELECT sample_id, approach, gen_norm, ref_norm, gen_norm = ref_norm AS exact,
       round(component_match, 6) AS component_match, round(structural_similarity, 6) AS structural_similarity
FROM scored""",
)
def h29_explain_pair(spark, sf_dir):
    """Normal forms, exact flag, component and structural scores of
    every pair side by side (the reference prints these for one pair)."""
    s = B.score_pairs(X.sql_pairs(spark, sf_dir))
    return s.select("sample_id", "approach", "gen_norm", "ref_norm", (F.col("gen_norm") == F.col("ref_norm")).alias("exact"),
                    B.r6("component_match").alias("component_match"),
                    B.r6("structural_similarity").alias("structural_similarity"))
