"""Text-to-SQL benchmark jobs: pair scoring (H9), the per-cell summary (A1),
comparative metrics (A8-A11), reports (A16-A20) and error analysis (A19).

Plan shape of ``run_sql_benchmark`` (U9):

    corpus --W1--> samples --(inner join on sample_id)--> responses
        --P6 filter--> H9 projection --partial agg--> shuffle(keys) --final agg
        --left join--> literal key grid (models x levels x approaches)

One shuffle join (responses with their reference query) and one small
aggregation shuffle; the per-cell aggregation is map-side combined, so a model
or level holding a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from verity.functions import sqltext as S
from verity.operators.partitioning import dealt, heavy_tasks
from verity.sources.fixtures import APPROACHES, COMPLEXITY_LEVELS

SCORE_COLUMNS = ("exact_match", "execution_match", "component_match", "token_efficiency", "semantic_similarity")
SUMMARY_METRICS = ("time", "tokens") + SCORE_COLUMNS


def r6(c) -> Column:
    """Round a double for stable comparison across engines."""
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def avg6(c) -> Column:
    """Mean rounded half-up to 6 decimals, summed as exact decimals so the
    result does not depend on partitioning (double sums do, in the last bits,
    which decides ties at the 7th decimal)."""
    c = c if isinstance(c, Column) else F.col(c)
    return F.round(F.avg(c.cast("decimal(28,8)")), 6).cast("double")


def _side_forms(df: DataFrame, query: str, side: str) -> DataFrame:
    """What scoring needs of one side of a pair (``side``: g or r), staged: what both normal
    forms begin with and its words' number, normal forms,
    then words, then n-grams (each the (n-1)-gram and a word), clause texts and flags.
    The basic form has a projection of its own: split and compared with '', it would be
    made twice."""
    norm = {"g": "gen_norm", "r": "ref_norm"}[side]
    plain = f"_{side}p"
    a = df.withColumn(plain, S.plain_form(query))
    a = a.withColumns({f"_{side}b": S.basic_of(plain), f"_{side}n": F.size(S.single_spaced_words(plain)).cast("bigint")})
    a = a.withColumnRenamed(plain, norm)
    for step in S.ADVANCED_STEPS:
        a = a.withColumn(norm, S.advanced_step(norm, step))
    a = a.withColumn(norm, F.coalesce(norm, F.lit("")))
    a = a.withColumns({f"_{side}t": S.single_spaced_words(f"_{side}b")}).drop(f"_{side}b")
    a = a.withColumns({f"_{side}h1": S.word_numbers(f"_{side}t")})
    for n in range(2, S.BLEU_MAX_N + 1):
        a = a.withColumns({f"_{side}h{n}": S.longer_ngrams(f"_{side}h{n - 1}", f"_{side}h1", n)})
    rng = range(1, S.BLEU_MAX_N + 1)
    a = a.withColumns({f"_{side}s{n}": S.sorted_if_repeating(f"_{side}h{n}") for n in rng})
    texts = {f"_{side}_{name}": S.clause_text(norm, pat) for name, pat, _ in S.CLAUSES}
    texts[f"_{side}_limit"] = S.apart(texts[f"_{side}_limit"])
    return a.withColumns({f"_{side}_flags": S.structure_flags(norm), **texts})


def reference_forms(samples: DataFrame, reference: str = "reference") -> DataFrame:
    """``samples`` with what ``score_pairs`` needs of their reference queries, so that a
    reference with many responses is read once (``prepared=True``)."""
    a = _side_forms(samples, reference, "r")
    return a.withColumns({"_r_columns": S.clause_columns("_r_select_cols"),
                          **{f"_rw_{name}": S.clause_words(f"_r_{name}") for name, _, _ in S.CLAUSES}})


def score_pairs(
    df: DataFrame,
    generated: str = "generated",
    reference: str = "reference",
    similarity: str = "bleu",
    token_count: Column | None = None,
    detail: bool = False,
    prepared: bool = False,
) -> DataFrame:
    """H9 composite score of each (generated, reference) pair.

    Intermediate values are staged as columns in successive projections:
    normal forms, then clause texts and n-gram arrays, then clipped n-gram
    matches, then the scores. ``CollapseProject`` does not inline a non-cheap
    expression referenced more than once, so each is built once per row (the
    reference renormalises each pair three times). ``token_count`` counts the
    generated text's tokens (default: whitespace words; pass a BPE counter to
    match a tokenizer). ``prepared``: ``df`` has the columns of ``reference_forms``.
    """
    tokens = token_count if token_count is not None else F.col("_gn")
    rng = range(1, S.BLEU_MAX_N + 1)
    base = [c for c in df.columns if not prepared or (c != "ref_norm" and not c.startswith("_r"))]
    a = df if prepared else reference_forms(df, reference)
    b = _side_forms(a, generated, "g").withColumn("_ntok", tokens)
    scores = {f"_s_{name}": F.when(F.col(f"_r_{name}") != "", S.clause_score(
        name, F.col(f"_g_{name}"), F.col(f"_r_{name}"), F.col(f"_rw_{name}"), F.col("_r_columns"))) for name, _, _ in S.CLAUSES}
    scores["_s_limit"] = S.apart(scores["_s_limit"])
    c = b.select(
        "*",
        *[S.clipped_matches(f"_gh{n}", f"_rh{n}", f"_gs{n}", f"_rs{n}").alias(f"_m{n}") for n in rng],
        *[s.alias(name) for name, s in scores.items()],
    )
    if similarity == "bleu":
        sim = S.bleu_from_counts(
            [F.col(f"_m{n}") for n in rng], [F.size(f"_gh{n}") for n in rng], F.size("_gh1"), F.size("_rh1")
        )
    elif similarity == "jaccard":
        sim = S.jaccard("_gt", "_rt")
    else:
        raise ValueError("similarity must be 'bleu' or 'jaccard'")
    comp = S.weighted_clauses([(F.col(f"_s_{name}"), w) for name, _, w in S.CLAUSES])
    extra = []
    if detail:
        extra = [F.array(*[
            F.struct(F.lit(name).alias("clause"), (F.col(f"_r_{name}") != "").alias("present"),
                     F.col(f"_s_{name}").alias("score"), F.lit(w).alias("weight"))
            for name, _, w in S.CLAUSES]).alias("clauses")]
    d = c.select(
        *base,
        "gen_norm",
        "ref_norm",
        (F.col("gen_norm") == F.col("ref_norm")).alias("_exact"),
        comp.alias("component_match"),
        S.structure_agreement("_g_flags", "_r_flags").alias("structural_similarity"),
        S.token_efficiency("_ntok").alias("token_efficiency"),
        sim.alias("semantic_similarity"),
        *extra,
    )
    execution = F.col("_exact") | (
        (F.col("component_match") > S.EXEC_COMPONENT_MIN) & (F.col("structural_similarity") > S.EXEC_STRUCTURAL_MIN)
    )
    return d.withColumn("exact_match", F.col("_exact").cast("double")).withColumn(
        "execution_match", execution.cast("double")
    ).drop("_exact")


SCORE_OUTPUT = ("gen_norm", "ref_norm", "component_match", "structural_similarity", "token_efficiency",
                "semantic_similarity", "exact_match", "execution_match")


def score_distinct_pairs(
    df: DataFrame,
    generated: str = "generated",
    reference: str = "reference",
    similarity: str = "bleu",
    detail: bool = False,
) -> DataFrame:
    """``score_pairs`` computed once per distinct (generated, reference) pair
    and joined back to every row.

    An option for callers who know that pairs repeat (equal answers to the same
    question across models and approaches): it shuffles the texts twice, which
    costs more than it saves where pairs are unique. ``distinct`` is aggregated map-side, so each task ships only
    its own distinct pairs; the join back is sized by AQE (broadcast when the
    distinct set is small, else a shuffle join). The join is null-safe.
    Results are identical to ``score_pairs`` (a pure function of the pair)."""
    keys = df.select(F.col(generated).alias("_kg"), F.col(reference).alias("_kr")).distinct()
    scored = score_pairs(keys, "_kg", "_kr", similarity, detail=detail)
    cols = list(SCORE_OUTPUT) + (["clauses"] if detail else [])
    s = scored.select("_kg", "_kr", *cols)
    j = df.join(s, df[generated].eqNullSafe(s["_kg"]) & df[reference].eqNullSafe(s["_kr"]), "left")
    return j.drop("_kg", "_kr")


def first_n_per_level(corpus: DataFrame, n: int | None, levels: Sequence[str] = COMPLEXITY_LEVELS) -> DataFrame:
    """The first ``n`` samples of each complexity level in corpus order.

    ``row_number() <= n`` is planned as a WindowGroupLimit: each map task keeps
    only its top ``n`` per level before the shuffle, so a level holding a third
    of the corpus ships ``n`` rows per task, not the level."""
    c = corpus.filter(F.col("complexity").isin(list(levels)))
    if n is None:
        return c
    w = Window.partitionBy("complexity").orderBy("ordinal")
    return c.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def key_grid(spark: SparkSession, models: Sequence[str], levels: Sequence[str] = COMPLEXITY_LEVELS,
             approaches: Sequence[str] = APPROACHES) -> DataFrame:
    """Literal grid of every (model, complexity, approach) cell; its size is
    the product of three argument lists, so it is bounded by construction."""
    rows = [(m, c, a, ci, ai) for m in models for ci, c in enumerate(levels) for ai, a in enumerate(approaches)]
    return spark.createDataFrame(
        rows, "model string, complexity string, approach string, level_ordinal int, approach_ordinal int"
    )


def summarize(scored: DataFrame, grid: DataFrame, drop_errors: bool = True) -> DataFrame:
    """A1: seven means and ``sample_count`` per (model, complexity, approach);
    error rows dropped first (P6); an empty cell yields zeros."""
    keys = ["model", "complexity", "approach"]
    ok = scored.filter(F.col("error").isNull()) if drop_errors else scored
    agg = ok.groupBy(*keys).agg(
        avg6("time_s").alias("time"),
        avg6("tokens_total").alias("tokens"),
        *[F.avg(c).alias(c) for c in SCORE_COLUMNS],
        F.count(F.lit(1)).alias("sample_count"),
    )
    # The aggregate, one row a key, is the side that may be broadcast; the
    # grid is the preserved side of the outer join, which cannot be.
    out = grid.join(agg, keys, "left")
    return out.select(
        *keys,
        *[r6(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in SUMMARY_METRICS],
        F.coalesce(F.col("sample_count"), F.lit(0)).cast("bigint").alias("sample_count"),
    )


def responses_with_reference(samples: DataFrame, responses: DataFrame, prepare: bool = False) -> DataFrame:
    """Each recorded response next to its sample's reference query. With ``prepare``
    the reference's forms come along (``score_pairs(..., prepared=True)``)."""
    s = samples.select("sample_id", "complexity", F.col("query").alias("reference"))
    return with_reference_forms(responses, s) if prepare else responses.join(s, "sample_id")


def with_reference_forms(responses: DataFrame, samples: DataFrame) -> DataFrame:
    """``responses`` next to their sample's columns and its ``reference``'s forms: made once a
    sample, after the samples are dealt, so that no forms are shuffled; never broadcast, being
    wide. Both sides are dealt over tasks by the samples' size, as scoring takes far longer
    than its bytes say."""
    n = heavy_tasks(samples)
    return dealt(responses, "sample_id", count=n).join(
        reference_forms(dealt(samples, "sample_id", count=n)).hint("merge"), "sample_id")


def run_sql_benchmark(
    spark: SparkSession,
    corpus: DataFrame,
    responses: DataFrame,
    models: Sequence[str],
    num_samples: int | None = None,
    levels: Sequence[str] = COMPLEXITY_LEVELS,
    similarity: str = "bleu",
    repeated_pairs: bool = False,
) -> DataFrame:
    """W1 -> J3 -> P6 -> H9 -> A1 over recorded responses.

    ``responses`` has (model, approach, sample_id, response, time_s,
    tokens_total, error). Missing responses behave like failed calls: they
    never reach the means, and their cells fall back to the grid's zeros.
    ``repeated_pairs``: score each distinct pair once, for responses known to
    repeat (see ``score_distinct_pairs``)."""
    samples = first_n_per_level(corpus, num_samples, levels)
    asked = responses.filter(F.col("model").isin(list(models)) & F.col("error").isNull())
    pairs = responses_with_reference(samples, asked, prepare=not repeated_pairs)
    scored = (score_distinct_pairs(pairs, "response", "reference", similarity) if repeated_pairs
              else score_pairs(pairs, "response", "reference", similarity, prepared=True))
    return summarize(scored, key_grid(spark, models, levels))
