"""DuckDB SQL text for the correctness oracle.

Each registered query has an independent ANSI/DuckDB formulation run by the
driver against the same parquet tables. The fixtures are rebuilt here as CTEs
from the raw tables, and the scorers as SQL expressions (RE2 regexes; the
fixture text is ASCII so RE2's ASCII classes agree with Java's ``(?U)``).
These are plain string builders for test SQL, not a query planner.
"""

from __future__ import annotations

from verity.functions.sqltext import BASIC_CLAUSES, CLAUSES, FLOAT_MIN, OPERATORS, STRUCTURES
from verity.sources.fixtures import (
    APPROACHES, ATTEMPT_RESPONSES, COMPLEXITY_LEVELS, COMPLEXITY_MAPPING, CORPUS_LABELS, MODELS, PART_DDL,
    TASKS, TEMPLATES, REQUEST_TASKS, REQUEST_MODELS, REQUEST_LANGUAGES, REQUEST_OPERATIONS,
)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def rre(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def strip(x: str) -> str:
    return rre(x, r"^\s+|\s+$", "")


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"


def wc(x: str) -> str:
    return f"CAST(len({words(x)}) AS BIGINT)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def avg6(x: str) -> str:
    """Exact-decimal mean rounded half-up to 6 decimals (as Spark's ``avg6``)."""
    t = f"CAST(sum(CAST({x} AS DECIMAL(28,8))) * 100000000 AS HUGEINT)"
    n = f"count({x})"
    return f"(CASE WHEN {n} = 0 THEN NULL WHEN {t} >= 0 THEN ({t} + 50 * {n}) // (100 * {n}) ELSE -((-{t} + 50 * {n}) // (100 * {n})) END) / 1000000.0"


# --- scorers ---------------------------------------------------------------
def norm_basic(x: str) -> str:
    s = strip(rre(f"lower({x})", r"\s+", " "))
    s = f"regexp_replace({s}, ';$', '')"
    for op in OPERATORS:
        s = rre(s, r"\s*" + op + r"\s*", f" {op} ")
    return s


def norm_adv(x: str) -> str:
    s = rre(strip(f"lower({x})"), r"\s+", " ")
    s = f"regexp_replace({s}, ';$', '')"
    s = rre(s, "`([^`]*)`", r"\1")
    s = rre(s, '"([^"]*)"', r"\1")
    s = rre(s, r"\binner\s+join\b", "join")
    s = rre(s, r"\b(left|right|full)\s+join\b", r"\1 join")
    s = rre(s, r"\b(group|order)\s+by\b", r"\1 by")
    s = rre(s, r"\b(\w+)\s+as\s+(\w+)", r"\1 \2")
    s = rre(s, r"\b(count|sum|avg|max|min)\s*\(", r"\1(")
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {s} END"


def clause(norm: str, pat: str) -> str:
    return strip(f"regexp_extract({norm}, {q('(?i)' + pat)}, 1)")


def _tok_score(g: str, r: str) -> str:
    return f"len(list_intersect(list_distinct({words(g)}), list_distinct({words(r)}))) / len(list_distinct({words(r)}))"


def clause_score(name: str, g: str, r: str) -> str:
    tok = _tok_score(g, r)
    if name != "select_cols":
        return tok
    cols = (
        rf"len(list_intersect(list_distinct(string_split_regex({g}, ',\s*')), "
        rf"list_distinct(string_split_regex({r}, ',\s*')))) / len(list_distinct(string_split_regex({r}, ',\s*')))"
    )
    return f"CASE WHEN contains({g} || {r}, '*') THEN {tok} ELSE {cols} END"


def component_match(gn: str = "gen_norm", rn: str = "ref_norm") -> str:
    weighted, total = "0.0::DOUBLE", "0.0::DOUBLE"
    for name, pat, w in CLAUSES:
        g, r = clause(gn, pat), clause(rn, pat)
        weighted = f"({weighted} + CASE WHEN {r} <> '' THEN ({clause_score(name, g, r)}) * {w}::DOUBLE ELSE 0.0 END)"
        total = f"({total} + CASE WHEN {r} <> '' THEN {w}::DOUBLE ELSE 0.0 END)"
    return f"CASE WHEN {total} > 0 THEN {weighted} / {total} ELSE 0.0 END"


def component_match_basic(gn: str, rn: str) -> str:
    matches, total = [], []
    for _, pat in BASIC_CLAUSES:
        g, r = clause(gn, pat), clause(rn, pat)
        total.append(f"CAST({r} <> '' AS INT)")
        matches.append(f"CAST({r} <> '' AND {g} = {r} AS INT)")
    t = " + ".join(total)
    return f"CASE WHEN ({t}) > 0 THEN ({' + '.join(matches)}) / ({t}) ELSE 0.0 END"


def structural(gn: str = "gen_norm", rn: str = "ref_norm") -> str:
    parts = [f"CAST(regexp_matches({gn}, {q(p)}) = regexp_matches({rn}, {q(p)}) AS INT)" for p in STRUCTURES]
    return f"(({' + '.join(parts)}) / {float(len(STRUCTURES))})"


def token_eff(n: str) -> str:
    return f"(1.0 - least(1.0, {n} / 200.0))"


def ngrams(t: str, n: int) -> str:
    return (
        f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n} + 2), "
        f"lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END"
    )


def clipped(g: str, r: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct({g}), lambda x: least("
        f"len(list_filter({g}, lambda y: y = x)), len(list_filter({r}, lambda y: y = x))))), 0)"
    )


def bleu_from(gt: str, rt: str) -> str:
    """BLEU over token-list expressions (inline; use on CTE columns)."""
    logs, m1 = [], None
    for n in range(1, 5):
        gn, rn = ngrams(gt, n), ngrams(rt, n)
        m = clipped(gn, rn)
        m1 = m1 or m
        p = f"CASE WHEN {m} > 0 THEN {m} / greatest(len({gn}), 1) ELSE {FLOAT_MIN!r} END"
        logs.append(f"0.25 * ln({p})")
    bp = f"CASE WHEN len({gt}) > len({rt}) THEN 1.0 WHEN len({gt}) = 0 THEN 0.0 ELSE exp(1.0 - len({rt}) / len({gt})) END"
    return f"CASE WHEN {m1} = 0 THEN 0.0 ELSE ({bp}) * exp({' + '.join(logs)}) END"


def jaccard_from(gt: str, rt: str) -> str:
    u = f"len(list_distinct({gt} || {rt}))"
    return f"CASE WHEN {u} > 0 THEN len(list_intersect(list_distinct({gt}), list_distinct({rt}))) / {u} ELSE 0.0 END"


# --- fixtures --------------------------------------------------------------
def _case_templates() -> str:
    arms = " ".join(
        f"WHEN {i} THEN {q(t.split('{n}')[0])} || CAST(p_size AS VARCHAR) || {q(t.split('{n}')[1])}"
        for i, t in enumerate(TEMPLATES)
    )
    return f"CASE p_partkey % 4 {arms} END"


def _complexity(label: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in COMPLEXITY_MAPPING)
    return f"coalesce(CASE {label} {arms} END, 'medium')"


CORPUS = f"""corpus AS (
  SELECT p_partkey AS sample_id,
         'Which rows match ' || p_name || '?' AS question,
         {_case_templates()} AS query,
         {q(PART_DDL)} AS table_info,
         concat_ws(' ', p_type, p_name) AS explanation,
         p_brand AS domain,
         'Parts of ' || p_brand AS domain_description,
         {lst(CORPUS_LABELS)}[p_partkey % 9 + 1] AS original_complexity,
         {lst(CORPUS_LABELS)}[p_partkey % 9 + 1] || ' queries' AS complexity_description,
         p_type AS task_type,
         'Tasks of type ' || p_type AS task_description,
         {_complexity(lst(CORPUS_LABELS) + '[p_partkey % 9 + 1]')} AS complexity,
         p_partkey AS ordinal
  FROM part)"""

APPROACH_VALUES = "approaches(approach, approach_ordinal) AS (VALUES " + ", ".join(
    f"({q(a)}, {i})" for i, a in enumerate(APPROACHES)) + ")"
MODEL_VALUES = "models(model, model_ordinal) AS (VALUES " + ", ".join(
    f"({q(m)}, {i})" for i, m in enumerate(MODELS)) + ")"


def variant(ref: str, change: str) -> str:
    return f"""CASE {change}
      WHEN 0 THEN {ref}
      WHEN 1 THEN regexp_replace(lower({ref}), ';$', '')
      WHEN 2 THEN '  ' || replace({ref}, ' ', ' ' || chr(10) || '  ') || '  '
      WHEN 3 THEN '```sql' || chr(10) || {ref} || chr(10) || '```'
      WHEN 4 THEN regexp_replace({ref}, ' (WHERE|GROUP BY) .*$', ';')
      WHEN 5 THEN replace(replace({ref}, 'INNER JOIN', 'JOIN'), ' AS ', ' ')
      WHEN 6 THEN ''
      ELSE 'SELECT 1;' END"""


SQL_PAIRS = f"""{CORPUS},
{APPROACH_VALUES},
sql_pairs AS (
  SELECT sample_id, complexity, approach, approach_ordinal,
         {variant('query', '(sample_id // 4 + approach_ordinal) % 8')} AS generated,
         query AS reference
  FROM corpus CROSS JOIN approaches)"""

SQL_RESPONSES = f"""{CORPUS},
{APPROACH_VALUES},
{MODEL_VALUES},
resp_base AS (
  SELECT c.sample_id, c.question, c.query, p.p_retailprice, m.model, m.model_ordinal, a.approach, a.approach_ordinal,
         {variant('c.query', '(c.sample_id // 4 + a.approach_ordinal + m.model_ordinal) % 8')} AS gen
  FROM corpus c JOIN part p ON p.p_partkey = c.sample_id CROSS JOIN models m CROSS JOIN approaches a
  WHERE NOT (m.model_ordinal = 1 AND c.sample_id % 23 = 0)),
sql_responses AS (
  SELECT model, approach, sample_id, gen AS response,
         p_retailprice / 1000 + approach_ordinal * 0.25 + model_ordinal * 0.1 AS time_s,
         {wc('question')} + {wc('gen')} AS tokens_total,
         CASE WHEN (sample_id + model_ordinal) % 17 = approach_ordinal THEN 'timeout' END AS error
  FROM resp_base)"""

RUNS = f"""runs AS (
  SELECT 'm' || CAST(l_suppkey % 3 AS VARCHAR) AS model,
         {lst(APPROACHES)}[l_linenumber % 4 + 1] AS approach,
         {lst(COMPLEXITY_LEVELS)}[l_partkey % 4 + 1] AS complexity,
         {lst(TASKS)}[l_orderkey % 4 + 1] AS task_type,
         l_extendedprice / 10000 AS time_s,
         CAST(l_quantity AS BIGINT) AS tokens,
         CAST(l_linenumber - 1 AS BIGINT) AS retries,
         CAST(l_quantity AS BIGINT) % 10 AS input_length,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'timeout' END AS error
  FROM lineitem)"""

RECORDED = """recorded_responses AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
  FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

ATTEMPTS = "attempts AS (SELECT user_id AS request_id, ts, event_id, CASE event_type " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in ATTEMPT_RESPONSES) + " END AS response FROM events)"

# DuckDB rounds on CAST(double AS BIGINT); Spark truncates, hence trunc().
REQUEST_LOG = """request_log AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS model,
         CAST(trunc(value) AS BIGINT) AS tokens, user_id
  FROM events)"""


def key_grid_sql(models=MODELS, levels=COMPLEXITY_LEVELS, approaches=APPROACHES) -> str:
    rows = ", ".join(
        f"({q(m)}, {q(c)}, {q(a)}, {ci}, {ai})"
        for m in models for ci, c in enumerate(levels) for ai, a in enumerate(approaches)
    )
    return f"grid(model, complexity, approach, level_ordinal, approach_ordinal) AS (VALUES {rows})"


def scored_pairs_sql(src: str, gen: str, ref: str, similarity: str = "bleu") -> str:
    """CTEs ``normed`` and ``scored`` over a source CTE ``src`` with columns
    ``gen`` and ``ref``: the H9 columns, same names as ``score_pairs``."""
    sim = bleu_from("gt", "rt") if similarity == "bleu" else jaccard_from("gt", "rt")
    return f"""normed AS (
  SELECT *, {norm_adv(gen)} AS gen_norm, {norm_adv(ref)} AS ref_norm,
         {words(norm_basic(gen))} AS gt, {words(norm_basic(ref))} AS rt
  FROM {src}),
scored0 AS (
  SELECT *, {component_match()} AS component_match,
         {structural()} AS structural_similarity,
         {token_eff(wc(gen))} AS token_efficiency,
         {sim} AS semantic_similarity
  FROM normed),
scored AS (
  SELECT *, CAST(gen_norm = ref_norm AS DOUBLE) AS exact_match,
         CAST(gen_norm = ref_norm OR (component_match > 0.85 AND structural_similarity > 0.7) AS DOUBLE) AS execution_match
  FROM scored0)"""


def summary_sql(scored: str = "scored") -> str:
    """CTE ``summary`` (A1) over a scored CTE with model/complexity/approach."""
    metrics = ["time", "tokens", "exact_match", "execution_match", "component_match", "token_efficiency",
               "semantic_similarity"]
    src = {"time": "time_s", "tokens": "tokens_total"}
    aggs = ", ".join((avg6(src[m]) if m in src else f"avg({m})") + f" AS {m}" for m in metrics)
    outs = ", ".join(f"round(coalesce(a.{m}, 0.0), 6) AS {m}" for m in metrics)
    return f"""agg AS (
  SELECT model, complexity, approach, {aggs}, count(*) AS sample_count
  FROM {scored} WHERE error IS NULL GROUP BY model, complexity, approach),
summary AS (
  SELECT g.model, g.complexity, g.approach, {outs},
         CAST(coalesce(a.sample_count, 0) AS BIGINT) AS sample_count, g.level_ordinal, g.approach_ordinal
  FROM grid g LEFT JOIN agg a USING (model, complexity, approach))"""


def avg_pct6(x: str) -> str:
    return f"round(avg({x}) * 100, 6)"


# The scored-response pipeline (U9 up to H9), with corpus dimensions.
SCORED_RESPONSES = f"""{SQL_RESPONSES},
pairs AS (
  SELECT r.*, c.complexity, c.task_type, c.domain, c.original_complexity, c.query AS reference
  FROM sql_responses r JOIN corpus c USING (sample_id)
  WHERE r.error IS NULL),
{scored_pairs_sql('pairs', 'response', 'reference')}"""

SUMMARY = f"""{SCORED_RESPONSES},
{key_grid_sql()},
{summary_sql()}"""

GENERAL_MODELS = ("m0", "m1", "m2")


def runs_means(by: str, count: bool = False) -> str:
    extra = ", count(*) AS count" if count else ""
    return f"""f AS (SELECT *, CASE WHEN error IS NULL THEN tokens ELSE 0 END AS tok FROM runs),
means AS (SELECT {by}, {avg6('time_s')} AS time, {avg6('tok')} AS tokens, {avg6('retries')} AS retries{extra}
          FROM f GROUP BY {by})"""


def _lst_null(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]"


REQUESTS = f"""requests AS (
  SELECT conv_id * 100000 + turn AS request_id,
         {lst(REQUEST_TASKS)}[conv_id % 6 + 1] AS task_type,
         CASE WHEN turn % 7 <> 3 THEN text END AS text,
         {_lst_null(REQUEST_LANGUAGES)}[turn % 4 + 1] AS target_language,
         {_lst_null(REQUEST_MODELS)}[conv_id % 4 + 1] AS model,
         {_lst_null(REQUEST_OPERATIONS)}[turn % 4 + 1] AS operation,
         CASE WHEN conv_id % 5 <> 0 THEN '2024-01-01' END AS date,
         CASE WHEN conv_id % 7 <> 0 THEN '{{}}' END AS schema_json
  FROM conversations)"""
