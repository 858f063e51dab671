"""Registered benchmark analytics: general benchmark (A2-A7, A21, A23, J2,
W2) on the ``runs`` facts, SQL-benchmark derivations (A8-A11, A16-A20, A22,
J5) on scored responses, and corpus statistics (S2, A13-A15, T1-T3, W1, W3,
P11, J1, J7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verity.operators import analytics as A
from verity.operators import sqlbench as B
from verity.plans import oracle as O
from verity.plans.catalog import register
from verity.sources import fixtures as X

GM = O.GENERAL_MODELS
_RUNS = f"WITH {O.RUNS}"


# --- general benchmark on runs ----------------------------------------------
@register("a2_model_approach_means", f"""{_RUNS}, {O.runs_means('model, approach')}
SELECT model, approach, time, tokens, retries FROM means""")
def a2_model_approach_means(spark, sf_dir):
    return A.model_means(X.runs(spark, sf_dir), ("model", "approach"))


@register("a3_model_task_approach_means", f"""{_RUNS}, {O.runs_means('model, task_type, approach', True)}
SELECT model, task_type, approach, time, tokens, retries, count FROM means""")
def a3_model_task_approach_means(spark, sf_dir):
    return A.model_means(X.runs(spark, sf_dir), ("model", "task_type", "approach"), count=True)


@register("a4_input_length_impact", f"""{_RUNS}, {O.runs_means('model, input_length, approach')}
SELECT model, input_length, approach, time, tokens FROM means""")
def a4_input_length_impact(spark, sf_dir):
    m = A.model_means(X.runs(spark, sf_dir), ("model", "input_length", "approach"))
    return m.select("model", "input_length", "approach", "time", "tokens")


def _best_sql(keys: str, metrics) -> str:
    st = " UNION ALL ".join(f"SELECT model, {keys}, '{m}' AS metric, {m} AS value FROM means" for m in metrics)
    return f"""st AS ({st}),
rk AS (SELECT *, row_number() OVER (PARTITION BY metric, {keys}
          ORDER BY value, list_position({O.lst(GM)}, model)) AS rn FROM st)
SELECT metric, {keys}, model AS best_model, value AS best_value FROM rk WHERE rn = 1"""


@register("a5_best_model_per_metric", f"""{_RUNS}, {O.runs_means('model, approach')},
{_best_sql('approach', A.GENERAL_METRICS)}""")
def a5_best_model_per_metric(spark, sf_dir):
    means = A.model_means(X.runs(spark, sf_dir), ("model", "approach"))
    return A.best_model(means, GM, ["approach"], A.GENERAL_METRICS)


@register("a6_best_model_per_task", f"""{_RUNS}, {O.runs_means('model, task_type, approach')},
{_best_sql('task_type, approach', ['time'])}""")
def a6_best_model_per_task(spark, sf_dir):
    means = A.model_means(X.runs(spark, sf_dir), ("model", "task_type", "approach"))
    return A.best_model(means, GM, ["task_type", "approach"], ["time"])


_IMP = ", ".join(
    f"CASE WHEN {m}_base = 0 THEN 0.0 ELSE round(({m}_base - {m}) / {m}_base * 100, 2) END AS {m}"
    for m in A.GENERAL_METRICS)
_BASES = ", ".join(
    f"max(CASE WHEN approach = 'raw' THEN {m} END) OVER (PARTITION BY model) AS {m}_base" for m in A.GENERAL_METRICS)


@register("a7_improvement_vs_raw", f"""{_RUNS}, {O.runs_means('model, approach')},
b AS (SELECT *, {_BASES} FROM means)
SELECT model, approach || '_vs_raw' AS comparison, {_IMP} FROM b WHERE approach <> 'raw'""")
def a7_improvement_vs_raw(spark, sf_dir):
    """A7 with J2 (approach next to its raw baseline)."""
    return A.improvements_vs_raw(A.model_means(X.runs(spark, sf_dir), ("model", "approach")))


_U10_KEYS = "section, task_type, input_length"
_U10_RAW = ", ".join(f"max(CASE WHEN approach = 'raw' THEN {m} END) OVER (PARTITION BY {_U10_KEYS}, model) AS {m}_base" for m in ("time", "tokens", "retries"))
_U10_BEST = ", ".join(f"row_number() OVER (PARTITION BY {_U10_KEYS}, approach ORDER BY {m}, list_position({O.lst(GM)}, model)) = 1 AS best_{m}"
                      for m in ("time", "tokens", "retries"))
_U10_GAIN = ", ".join(f"CASE WHEN approach = 'raw' THEN NULL WHEN {m}_base = 0 THEN 0.0 ELSE round(({m}_base - {m}) / {m}_base * 100, 2) END AS {m}_vs_raw"
                      for m in ("time", "tokens", "retries"))


def _u10_section(name: str, task: str, length: str, by: str) -> str:
    return (f"SELECT '{name}' AS section, model, {task} AS task_type, {length} AS input_length, approach, {O.avg6('time_s')} AS time, "
            f"{O.avg6('tok')} AS tokens, {O.avg6('retries')} AS retries, count(*) AS count FROM f GROUP BY {by}")


@register("u10_general_benchmark", f"""{_RUNS}, f AS (SELECT *, CASE WHEN error IS NULL THEN tokens ELSE 0 END AS tok FROM runs),
cells AS ({_u10_section('approaches', 'NULL', 'NULL', 'model, approach')}
  UNION ALL {_u10_section('task_specific', 'task_type', 'NULL', 'model, task_type, approach')}
  UNION ALL {_u10_section('input_length_impact', 'NULL', 'input_length', 'model, input_length, approach')}),
wide AS (SELECT *, {_U10_RAW}, {_U10_BEST} FROM cells)
SELECT section, model, task_type, input_length, approach, time, tokens, retries, count, best_time, best_tokens, best_retries, {_U10_GAIN} FROM wide""")
def u10_general_benchmark(spark, sf_dir):
    """A2-A7's tables as one report, from one scan of the facts."""
    return A.general_report(X.runs(spark, sf_dir), GM)


_GRID3 = "grid(model, task_type, approach) AS (SELECT * FROM (VALUES {}) )".format(
    ", ".join(f"({O.q(m)}, {O.q(t)}, {O.q(a)})" for m in GM for t in X.TASKS for a in X.APPROACHES))


@register("a21_task_chart_dataset", f"""{_RUNS}, {O.runs_means('model, task_type, approach')},
{_GRID3}
SELECT g.model, g.task_type, g.approach, coalesce(m.time, 0.0) AS time, coalesce(m.tokens, 0.0) AS tokens
FROM grid g LEFT JOIN means m USING (model, task_type, approach)""")
def a21_task_chart_dataset(spark, sf_dir):
    """Time and tokens per task x model x approach over the full grid
    (a missing task is 0, as in the charts)."""
    means = A.model_means(X.runs(spark, sf_dir), ("model", "task_type", "approach"))
    keys = ["model", "task_type", "approach"]
    grid = A.literal_grid(spark, keys, GM, X.TASKS, X.APPROACHES)
    return A.with_grid(means, grid, keys, ["time", "tokens"])


@register("a23_task_comparison_table", f"""{_RUNS}, {O.runs_means('model, approach')},
tm AS (SELECT DISTINCT task_type, model FROM runs)
SELECT tm.task_type, tm.model, 'N/A' AS parameter, 0 AS temperature, 1 AS turns,
       CAST(round(CAST(m.time AS DECIMAL(24,6)), 2) AS VARCHAR) || 's' AS processing_time,
       m.tokens AS tokens_utilized, NULL::VARCHAR AS raw, NULL::VARCHAR AS controlled,
       NULL::VARCHAR AS few_shot, NULL::VARCHAR AS fine_tuned
FROM tm JOIN means m ON m.model = tm.model AND m.approach = 'raw'""")
def a23_task_comparison_table(spark, sf_dir):
    """Per task, one row per model that ran it: the model's overall raw
    time and tokens; the per-approach quality columns stay NULL because no
    quality score exists (the reference would fail formatting them)."""
    runs = X.runs(spark, sf_dir)
    means = A.model_means(runs, ("model", "approach")).filter(F.col("approach") == "raw")
    tm = runs.select("task_type", "model").distinct()
    j = tm.join(means, "model")
    return j.select(
        "task_type", "model", F.lit("N/A").alias("parameter"), F.lit(0).alias("temperature"),
        F.lit(1).alias("turns"), F.concat(A.fmt2(F.col("time")), F.lit("s")).alias("processing_time"),
        F.col("tokens").alias("tokens_utilized"),
        *[F.lit(None).cast("string").alias(a) for a in X.APPROACHES],
    )


@register("w2_running_retry_count", f"""WITH {O.REQUEST_LOG}
SELECT event_id, model, count(*) OVER (PARTITION BY model ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS retries FROM request_log""")
def w2_running_retry_count(spark, sf_dir):
    """A controller shared by every call of a task counts all earlier
    outputs: running count - 1 per task in call order (three-level prefix sum,
    so one busy task type never sits whole in one task)."""
    log = X.request_log(spark, sf_dir).select("event_id", "model")
    r = A.running_count(log, "model", "event_id", bucket_rows=1024)
    return r.select("event_id", "model", (F.col("running") - 1).alias("retries"))


# --- SQL benchmark derivations ------------------------------------------------
def _scored(spark, sf_dir, detail=False, domains=None):
    """Every answered response with its scores, of all samples or those of ``domains``."""
    corpus = X.corpus(spark, sf_dir)
    if domains is not None:
        corpus = corpus.join(F.broadcast(domains), "domain", "left_semi")
    dims = corpus.select("sample_id", "complexity", "task_type", "domain", "original_complexity",
                         F.col("query").alias("reference"))
    pairs = B.with_reference_forms(X.sql_responses(spark, sf_dir).filter(F.col("error").isNull()), dims)
    return B.score_pairs(pairs, "response", "reference", detail=detail, prepared=True)


def _summary(spark, sf_dir):
    return B.summarize(_scored(spark, sf_dir), B.key_grid(spark, X.MODELS))


_S = f"WITH {O.SUMMARY}"
_SC = f"WITH {O.SCORED_RESPONSES}"
IMPACT = ("exact_match", "execution_match", "time", "tokens")


@register("a8_complexity_impact", f"""{_S},
st AS ({' UNION ALL '.join(f"SELECT model, complexity, approach, '{m}' AS metric, {m} AS value FROM summary"
                           for m in IMPACT)})
SELECT model, metric, complexity, {', '.join(f"max(CASE WHEN approach = '{a}' THEN value END) AS {a}"
                                             for a in X.APPROACHES)}
FROM st GROUP BY model, metric, complexity""")
def a8_complexity_impact(spark, sf_dir):
    return A.complexity_impact(_summary(spark, sf_dir))


_ACC, _COST = ("exact_match", "execution_match", "component_match"), ("time", "tokens")
_B9 = ", ".join(f"max(CASE WHEN approach = 'raw' THEN {m} END) OVER (PARTITION BY model, complexity) AS {m}_base"
                for m in _ACC + _COST)
_E9 = ", ".join([f"round(CASE WHEN {m}_base > 0 THEN ({m} / {m}_base - 1) * 100 ELSE 0.0 END, 6) AS {m}"
                 for m in _ACC] + [f"round(CASE WHEN {m}_base > 0 THEN (1 - {m} / {m}_base) * 100 ELSE 0.0 END, 6) AS {m}"
                                   for m in _COST])


@register("a9_approach_efficiency", f"""{_S},
b AS (SELECT *, {_B9} FROM summary)
SELECT model, complexity, approach, {_E9} FROM b WHERE approach <> 'raw'""")
def a9_approach_efficiency(spark, sf_dir):
    return A.approach_efficiency(_summary(spark, sf_dir))


_IMP10 = ("((CASE WHEN time_base > 0 THEN (1 - time / time_base) * 100 ELSE 0.0 END) + "
          "(CASE WHEN tokens_base > 0 THEN (1 - tokens / tokens_base) * 100 ELSE 0.0 END)) / 2")
_B10 = ", ".join(f"max(CASE WHEN approach = 'raw' THEN {m} END) OVER (PARTITION BY model, complexity) AS {m}_base"
                 for m in ("time", "tokens", "sample_count"))


@register("a10_overall_improvement", f"""{_S},
b AS (SELECT *, {_B10} FROM summary)
SELECT model, complexity, approach, round({_IMP10}, 6) AS improvement FROM b WHERE approach <> 'raw'""")
def a10_overall_improvement(spark, sf_dir):
    return A.overall_improvement(_summary(spark, sf_dir))


def _f1(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(24,6)), 1) AS VARCHAR)"


_T11 = [f"max(sample_count_base) AS query_count"]
for _a in X.APPROACHES:
    _w = f"approach = '{_a}'"
    _T11 += [f"max(CASE WHEN {_w} THEN {_f1('exact_match * 100')} || '%' END) AS {_a}_exact_match",
             f"max(CASE WHEN {_w} THEN {_f1('execution_match * 100')} || '%' END) AS {_a}_execution_match",
             f"max(CASE WHEN {_w} THEN {_f1('tokens')} END) AS {_a}_tokens",
             f"max(CASE WHEN {_w} THEN {_f1('time * 1000')} END) AS {_a}_time_ms"]
    if _a != "raw":
        _T11.append(f"max(CASE WHEN {_w} THEN {_f1(_IMP10)} || '%' END) AS {_a}_improvement")


@register("a11_comparison_table", f"""{_S},
b AS (SELECT *, {_B10} FROM summary)
SELECT model, upper(substr(complexity, 1, 1)) || substr(complexity, 2) AS complexity, {', '.join(_T11)}
FROM b GROUP BY model, complexity""")
def a11_comparison_table(spark, sf_dir):
    """A11 (with A10 and H26 formatting)."""
    return A.comparison_table(_summary(spark, sf_dir))


def _by_dim(scored, dim):
    return scored.groupBy("model", dim, "approach").agg(
        B.r6(F.avg("exact_match") * 100).alias("exact_match_pct"),
        B.r6(F.avg("execution_match") * 100).alias("execution_match_pct"),
        B.r6(B.avg6("time_s") * 1000).alias("time_ms"),
        B.avg6("tokens_total").alias("tokens"),
    )


def _by_dim_sql(dim: str, where: str = "") -> str:
    return f"""SELECT model, {dim}, approach, {O.avg_pct6('exact_match')} AS exact_match_pct,
       {O.avg_pct6('execution_match')} AS execution_match_pct, round({O.avg6('time_s')} * 1000, 6) AS time_ms,
       {O.avg6('tokens_total')} AS tokens
FROM scored {where} GROUP BY model, {dim}, approach"""


@register("a16_report_by_task_type", f"{_SC}\n{_by_dim_sql('task_type')}")
def a16_report_by_task_type(spark, sf_dir):
    """Real per-task-type metrics (the reference prints the medium-level
    numbers for every task type; that compat view is ``j5_...``)."""
    return _by_dim(_scored(spark, sf_dir), "task_type")


@register("a17_report_by_domain", f"""{_SC},
top AS (SELECT DISTINCT domain FROM corpus ORDER BY domain LIMIT 10)
{_by_dim_sql('domain', 'WHERE domain IN (SELECT domain FROM top)')}""")
def a17_report_by_domain(spark, sf_dir):
    """A17 restricted to the first 10 domains alphabetically (T3); the
    10-row side is bounded by its limit, so it is broadcast. The samples are
    chosen before their responses are scored."""
    top = X.corpus(spark, sf_dir).select("domain").distinct().orderBy("domain").limit(10)
    return _by_dim(_scored(spark, sf_dir, domains=top), "domain")


@register("a18_report_by_original_complexity", f"{_SC}\n{_by_dim_sql('original_complexity')}")
def a18_report_by_original_complexity(spark, sf_dir):
    return _by_dim(_scored(spark, sf_dir), "original_complexity")


@register("a22_task_type_exact_pct", f"""{_SC}
SELECT model, task_type, approach, {O.avg_pct6('exact_match')} AS exact_match_pct
FROM scored GROUP BY model, task_type, approach""")
def a22_task_type_exact_pct(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.groupBy("model", "task_type", "approach").agg(
        B.r6(F.avg("exact_match") * 100).alias("exact_match_pct"))


@register("j5_medium_proxy_report", f"""{_S},
labels AS (SELECT DISTINCT task_type FROM corpus)
SELECT l.task_type, s.model, s.approach, round(s.exact_match * 100, 6) AS exact_match_pct,
       round(s.execution_match * 100, 6) AS execution_match_pct, round(s.time * 1000, 6) AS time_ms, s.tokens
FROM labels l CROSS JOIN summary s WHERE s.complexity = 'medium'""")
def j5_medium_proxy_report(spark, sf_dir):
    """J5 (compat): every label x the 'medium' cells, as the reference's three
    reports print them. The summary side is a key-grid-sized table, so it is
    the broadcast side of the cross join."""
    labels = X.corpus(spark, sf_dir).select("task_type").distinct()
    med = _summary(spark, sf_dir).filter(F.col("complexity") == "medium")
    j = labels.crossJoin(F.broadcast(med))
    return j.select("task_type", "model", "approach",
                    B.r6(F.col("exact_match") * 100).alias("exact_match_pct"),
                    B.r6(F.col("execution_match") * 100).alias("execution_match_pct"),
                    B.r6(F.col("time") * 1000).alias("time_ms"), "tokens")


_A19 = " UNION ALL ".join(
    f"SELECT model, approach, {O.q(name)} AS clause, 1 - ({O.clause_score(name, O.clause('gen_norm', pat), O.clause('ref_norm', pat))}) AS err "
    f"FROM scored WHERE {O.clause('ref_norm', pat)} <> ''" for name, pat, _ in B.S.CLAUSES)


@register("a19_component_error_rate", f"""{_SC},
e AS ({_A19})
SELECT model, approach, clause, round(avg(err), 6) AS error_rate, count(*) AS n FROM e GROUP BY model, approach, clause""")
def a19_component_error_rate(spark, sf_dir):
    """A19 [re-aim]: real mismatch rate per SQL clause and approach from the
    per-clause scores of H7 (the reference plots invented constants)."""
    s = _scored(spark, sf_dir, detail=True)
    # explode_outer: a plain explode makes the optimizer infer and push down
    # size(clauses) > 0, copying the whole scorer into that filter.
    e = s.select("model", "approach", F.explode_outer("clauses").alias("c")).filter(F.col("c.present"))
    return e.groupBy("model", "approach", F.col("c.clause").alias("clause")).agg(
        B.r6(F.avg(1 - F.col("c.score"))).alias("error_rate"), F.count(F.lit(1)).alias("n"))


_A20 = (("exact_match_pct", "exact_match * 100"), ("execution_match_pct", "execution_match * 100"),
        ("tokens", "tokens"), ("time_ms", "time * 1000"), ("exact_match", "exact_match"),
        ("execution_match", "execution_match"), ("component_match", "component_match"),
        ("token_efficiency", "token_efficiency"), ("semantic_similarity", "semantic_similarity"))


@register("a20_sql_chart_datasets", f"""{_S}
{' UNION ALL '.join(f"SELECT model, complexity, approach, '{k}' AS metric, round({e}, 6) AS value FROM summary"
                    for k, e in _A20)}""")
def a20_sql_chart_datasets(spark, sf_dir):
    """The chart series (accuracy %, tokens, time ms, radar metrics) in
    long form: one ``stack`` over the summary, no drawing."""
    s = _summary(spark, sf_dir)
    args = ", ".join(f"'{k}', {e}" for k, e in _A20)
    return s.select("model", "complexity", "approach",
                    F.expr(f"stack({len(_A20)}, {args}) as (metric, value)")).withColumn("value", B.r6("value"))


# --- corpus -----------------------------------------------------------------
_C = f"WITH {O.CORPUS}"


@register("s2_corpus_load", f"{_C} SELECT * FROM corpus")
def s2_corpus_load(spark, sf_dir):
    return X.corpus(spark, sf_dir)


@register("a13_domain_counts", f"{_C} SELECT domain, count(*) AS count FROM corpus GROUP BY domain")
def a13_domain_counts(spark, sf_dir):
    return X.corpus(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("count"))


@register("a14_corpus_metadata", f"""{_C}
SELECT DISTINCT 'complexity_types' AS kind, original_complexity AS label FROM corpus UNION ALL
SELECT DISTINCT 'task_types', task_type FROM corpus UNION ALL SELECT DISTINCT 'domains', domain FROM corpus""")
def a14_corpus_metadata(spark, sf_dir):
    """Distinct labels as (kind, label) rows, so that no row holds a whole
    vocabulary; one scan, combined map-side."""
    kinds = (("complexity_types", "original_complexity"), ("task_types", "task_type"), ("domains", "domain"))
    labels = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("label")) for k, c in kinds])
    return X.corpus(spark, sf_dir).select(F.explode(labels).alias("x")).select("x.*").distinct()


@register("a15_corpus_stats", f"""{_C}
SELECT complexity, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM corpus GROUP BY complexity""")
def a15_corpus_stats(spark, sf_dir):
    c = X.corpus(spark, sf_dir).groupBy("complexity").agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("percent", B.r6(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy())))


@register("t1_sorted_labels", f"{_C} SELECT DISTINCT original_complexity FROM corpus ORDER BY 1")
def t1_sorted_labels(spark, sf_dir):
    return X.corpus(spark, sf_dir).select("original_complexity").distinct().orderBy("original_complexity")


@register("t2_top15_domains", f"""{_C}
SELECT domain, count(*) AS count, min(ordinal) AS first_ordinal FROM corpus GROUP BY domain
ORDER BY count DESC, first_ordinal LIMIT 15""")
def t2_top15_domains(spark, sf_dir):
    """Top 15 domains by count, ties by first appearance (a top-k)."""
    c = X.corpus(spark, sf_dir).groupBy("domain").agg(
        F.count(F.lit(1)).alias("count"), F.min("ordinal").alias("first_ordinal"))
    return c.orderBy(F.desc("count"), "first_ordinal").limit(15)


@register("t3_first10_domains", f"{_C} SELECT DISTINCT domain FROM corpus ORDER BY domain LIMIT 10")
def t3_first10_domains(spark, sf_dir):
    return X.corpus(spark, sf_dir).select("domain").distinct().orderBy("domain").limit(10)


@register("w1_first_n_per_level", f"""{_C}
SELECT sample_id, complexity FROM (
  SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY ordinal) AS rn FROM corpus) WHERE rn <= 20""")
def w1_first_n_per_level(spark, sf_dir):
    """W1 with the reference's default of 20 samples per level."""
    return B.first_n_per_level(X.corpus(spark, sf_dir), 20).select("sample_id", "complexity")


@register("w3_few_shot_examples", f"""{_C},
firsts AS (SELECT *, list_position({O.lst(X.COMPLEXITY_LEVELS)}, complexity) AS lvl FROM (
  SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY ordinal) AS rn FROM corpus) WHERE rn = 1
  AND complexity IN {tuple(X.COMPLEXITY_LEVELS)})
SELECT row_number() OVER (ORDER BY lvl) AS slot, sample_id, complexity, question, query
FROM firsts ORDER BY lvl LIMIT 3""")
def w3_few_shot_examples(spark, sf_dir):
    """The few-shot examples (first item of each level, level order, up
    to 3; topped up from the simple level when short)."""
    return A.few_shot_examples(X.corpus(spark, sf_dir)).drop("table_info")


@register("p11_quick_run", f"""WITH {O.SQL_RESPONSES},
{O.key_grid_sql(levels=('simple',))},
first5 AS (SELECT sample_id FROM (SELECT sample_id, row_number() OVER (PARTITION BY complexity ORDER BY ordinal) AS rn
           FROM corpus WHERE complexity = 'simple') WHERE rn <= 5),
pairs AS (
  SELECT r.*, c.complexity, c.query AS reference
  FROM sql_responses r JOIN corpus c USING (sample_id)
  WHERE r.error IS NULL AND r.sample_id IN (SELECT sample_id FROM first5)),
{O.scored_pairs_sql('pairs', 'response', 'reference')},
{O.summary_sql()}
SELECT model, complexity, approach, time, tokens, exact_match, execution_match, component_match,
       token_efficiency, semantic_similarity, sample_count FROM summary""")
def p11_quick_run(spark, sf_dir):
    """One level ('simple'), 5 samples: the level filter reaches the
    corpus before the join."""
    return B.run_sql_benchmark(spark, X.corpus(spark, sf_dir), X.sql_responses(spark, sf_dir), X.MODELS, 5,
                               ("simple",))


@register("j1_benchmark_grid", f"""WITH {O.CORPUS}, {O.APPROACH_VALUES}, {O.MODEL_VALUES}
SELECT m.model, c.sample_id, c.complexity, a.approach FROM corpus c CROSS JOIN models m CROSS JOIN approaches a""")
def j1_benchmark_grid(spark, sf_dir):
    """Models x samples x approaches; the model and approach sides are
    literal argument lists (bounded), broadcast against the sample scan."""
    return A.benchmark_grid(spark, X.corpus(spark, sf_dir), X.MODELS)


@register("j7_replay_join", f"""WITH {O.SQL_RESPONSES}, grid AS (
  SELECT m.model, c.sample_id, a.approach FROM corpus c CROSS JOIN models m CROSS JOIN approaches a)
SELECT g.model, g.sample_id, g.approach, r.response,
       CASE WHEN r.sample_id IS NULL THEN 'no response' ELSE r.error END AS error
FROM grid g LEFT JOIN sql_responses r USING (model, sample_id, approach)""")
def j7_replay_join(spark, sf_dir):
    """Every requested call next to its recorded response; a call with
    no recording gets error 'no response'."""
    grid = A.benchmark_grid(spark, X.corpus(spark, sf_dir), X.MODELS).drop("complexity")
    return A.replay(grid, X.sql_responses(spark, sf_dir), ["model", "sample_id", "approach"])


def _f1sql(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(24,6)), 1) AS VARCHAR)"


@register("s11_task_type_report", f"""{_SC},
r AS ({_by_dim_sql('task_type')})
SELECT '# Performance Analysis by SQL Task Type' AS value UNION ALL SELECT ''
UNION ALL SELECT '| task_type | Approach | Exact Match | Execution Match | Time (ms) | Tokens |'
UNION ALL SELECT '|---|---|---|---|---|---|'
UNION ALL SELECT '| ' || task_type || ' | ' || approach || ' | ' || {_f1sql('exact_match_pct')} || '% | '
       || {_f1sql('execution_match_pct')} || '% | ' || {_f1sql('time_ms')} || ' | ' || {_f1sql('tokens')} || ' |' FROM r""")
def s11_task_type_report(spark, sf_dir):
    """The by-task-type report (A16) as Markdown lines, ready for
    ``sinks.write_report`` (one small file)."""
    from verity.operators.sinks import report_lines
    m = _by_dim(_scored(spark, sf_dir), "task_type")
    return report_lines(m, "Performance Analysis by SQL Task Type", "task_type", ["task_type", "model", "approach"])
