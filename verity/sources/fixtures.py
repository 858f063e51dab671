"""Benchmark-shaped tables derived from the input tables by fixed expressions.

Each derivation is a narrow projection or a key-unique self join, so it costs
one scan of its source (plus one shuffle for ``recorded_responses``) and grows
with the data. The same rows are rebuilt in DuckDB by ``verity.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.functions import sqltext as S
from verity.operators.partitioning import spread
from verity.sources.tables import table

# ---------------------------------------------------------------------------
# FIXED VALUES
# Approaches, in order: raw, controlled, few_shot, fine_tuned
# Complexity levels, in order: simple, medium, complex, extra
# Complexity mapping of the corpus labels (anything else -> medium):
#   basic SQL -> simple, single join -> medium, multiple joins -> complex,
#   aggregation -> medium, subquery -> complex, window functions -> extra,
#   set operations -> complex, data definition language -> medium
# ---------------------------------------------------------------------------
APPROACHES = ("raw", "controlled", "few_shot", "fine_tuned")
COMPLEXITY_LEVELS = ("simple", "medium", "complex", "extra")
COMPLEXITY_MAPPING = (
    ("basic SQL", "simple"),
    ("single join", "medium"),
    ("multiple joins", "complex"),
    ("aggregation", "medium"),
    ("subquery", "complex"),
    ("window functions", "extra"),
    ("set operations", "complex"),
    ("data definition language", "medium"),
)
DEFAULT_COMPLEXITY = "medium"

# Fixture choices of our own (not reference values).
CORPUS_LABELS = tuple(k for k, _ in COMPLEXITY_MAPPING) + ("graph traversal",)
TASKS = ("translation", "sql", "json", "sentiment")
MODELS = ("m0", "m1")
PART_DDL = (
    "CREATE TABLE part (p_partkey INT, p_name TEXT, p_brand TEXT, p_type TEXT, "
    "p_size INT, p_retailprice REAL);"
)
TEMPLATES = (
    "SELECT p_name, p_size FROM part WHERE p_size > {n};",
    "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC LIMIT {n};",
    "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c "
    "ON o.o_custkey = c.c_custkey WHERE o.o_totalprice >= {n};",
    "SELECT p_type, AVG(p_retailprice) FROM part GROUP BY p_type "
    "HAVING AVG(p_retailprice) > {n};",
)
ATTEMPT_RESPONSES = (
    ("purchase", "Positive."),
    ("signup", "Positive."),
    ("error", "NEGATIVE!"),
    ("view", "It is neutral"),
    ("click", "no idea"),
)


def complexity_of(label: Column) -> Column:
    """Bucket a corpus complexity label; unknown -> ``medium``."""
    m = F.create_map(*[F.lit(x) for kv in COMPLEXITY_MAPPING for x in kv])
    return F.coalesce(m[label], F.lit(DEFAULT_COMPLEXITY))


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str, extra=()) -> DataFrame:
    """S2 + P7 + P8: the text-to-SQL corpus, one row per part (``extra``
    part columns are carried along from the same scan)."""
    p = table(spark, sf_dir, "part")
    size = p.p_size.cast("string")
    query = F.when(p.p_partkey % 4 == 0, F.format_string(TEMPLATES[0].replace("{n}", "%s"), size))
    for i in (1, 2, 3):
        query = query.when(p.p_partkey % 4 == i, F.format_string(TEMPLATES[i].replace("{n}", "%s"), size))
    label = _pick(CORPUS_LABELS, p.p_partkey % 9)
    return p.select(
        p.p_partkey.alias("sample_id"),
        F.concat(F.lit("Which rows match "), p.p_name, F.lit("?")).alias("question"),
        query.alias("query"),
        F.lit(PART_DDL).alias("table_info"),
        F.concat_ws(" ", p.p_type, p.p_name).alias("explanation"),
        p.p_brand.alias("domain"),
        F.concat(F.lit("Parts of "), p.p_brand).alias("domain_description"),
        label.alias("original_complexity"),
        F.concat(label, F.lit(" queries")).alias("complexity_description"),
        p.p_type.alias("task_type"),
        F.concat(F.lit("Tasks of type "), p.p_type).alias("task_description"),
        complexity_of(label).alias("complexity"),
        p.p_partkey.alias("ordinal"),
        *extra,
    )


def _variant(ref: Column, change: Column) -> Column:
    """Generated text = the reference changed by one of eight rules."""
    return (
        F.when(change == 0, ref)
        .when(change == 1, F.regexp_replace(F.lower(ref), ";$", ""))
        .when(change == 2, F.concat(F.lit("  "), F.replace(ref, F.lit(" "), F.lit(" \n  ")), F.lit("  ")))
        .when(change == 3, F.concat(F.lit("```sql\n"), ref, F.lit("\n```")))
        .when(change == 4, F.regexp_replace(ref, " (WHERE|GROUP BY) .*$", ";"))
        .when(change == 5, F.replace(F.replace(ref, F.lit("INNER JOIN"), F.lit("JOIN")), F.lit(" AS "), F.lit(" ")))
        .when(change == 6, F.lit(""))
        .otherwise(F.lit("SELECT 1;"))
    )


def _approaches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(a, i) for i, a in enumerate(APPROACHES)], "approach string, approach_ordinal int"
    )


def sql_pairs(spark: SparkSession, sf_dir: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """corpus x 4 approaches: (generated, reference) pairs. The approach side
    is a fixed 4-row literal, so broadcasting it is bounded. ``prepare`` adds columns
    to the references, once a sample."""
    c = spread(corpus(spark, sf_dir).select("sample_id", "complexity", F.col("query").alias("reference")))
    c = prepare(c) if prepare else c
    a = F.broadcast(_approaches(spark))
    j = c.crossJoin(a)
    change = (F.floor(j.sample_id / 4) + j.approach_ordinal) % 8
    return j.select(
        "sample_id",
        "complexity",
        "approach",
        "approach_ordinal",
        _variant(F.col("reference"), change).alias("generated"),
        *[x for x in c.columns if x not in ("sample_id", "complexity")],
    )


def sql_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded benchmark responses per (model, approach, sample): the
    generated text shifts with the model, time/tokens are fixed expressions,
    some calls failed and model ``m1`` lacks every 23rd sample."""
    c = spread(corpus(spark, sf_dir, extra=("p_retailprice",)).select("sample_id", "question", "query",
                                                                     "p_retailprice"))
    models = spark.createDataFrame([(m, i) for i, m in enumerate(MODELS)], "model string, model_ordinal int")
    j = c.crossJoin(F.broadcast(models)).crossJoin(F.broadcast(_approaches(spark)))
    j = j.filter(~((j.model_ordinal == 1) & (j.sample_id % 23 == 0)))
    change = (F.floor(j.sample_id / 4) + j.approach_ordinal + j.model_ordinal) % 8
    gen = _variant(j.query, change)
    return j.select(
        "model",
        "approach",
        "sample_id",
        gen.alias("response"),
        (j.p_retailprice / 1000 + j.approach_ordinal * 0.25 + j.model_ordinal * 0.1).alias("time_s"),
        (S.word_count(j.question) + S.word_count(gen)).alias("tokens_total"),
        F.when((j.sample_id + j.model_ordinal) % 17 == j.approach_ordinal, F.lit("timeout")).alias("error"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long fact table of the general benchmark, one row per lineitem."""
    li = table(spark, sf_dir, "lineitem")
    tokens = li.l_quantity.cast("bigint")
    return li.select(
        F.concat(F.lit("m"), (li.l_suppkey % 3).cast("string")).alias("model"),
        _pick(APPROACHES, li.l_linenumber % 4).alias("approach"),
        _pick(COMPLEXITY_LEVELS, li.l_partkey % 4).alias("complexity"),
        _pick(TASKS, li.l_orderkey % 4).alias("task_type"),
        (li.l_extendedprice / 10000).alias("time_s"),
        tokens.alias("tokens"),
        (li.l_linenumber - 1).cast("bigint").alias("retries"),
        (tokens % 10).alias("input_length"),
        F.when((li.l_returnflag == "R") & (li.l_linestatus == "O"), F.lit("timeout")).alias("error"),
    )


def recorded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn = prompt; the next turn of the same conversation, when it is
    an assistant turn, = response (else null). A left equi-join on the unique
    (conv_id, turn) pair instead of a window, so a long conversation never
    lands whole in one task."""
    conv = table(spark, sf_dir, "conversations")
    users = conv.filter(conv.role == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    nxt = conv.filter(conv.role == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return users.join(nxt, ["conv_id", "turn"], "left")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry attempts: one event = one model call of request ``user_id``;
    the order key is (ts, event_id). Attempt numbers are assigned only where
    an operator needs the first k (see ``verity.operators.replay``)."""
    ev = table(spark, sf_dir, "events")
    resp = F.create_map(*[F.lit(x) for kv in ATTEMPT_RESPONSES for x in kv])
    return ev.select(
        F.col("user_id").alias("request_id"),
        "ts",
        "event_id",
        resp[F.col("event_type")].alias("response"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log rows: timestamp, model, tokens (stream and window usage)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"),
        F.col("value").cast("bigint").alias("tokens"),
        "user_id",
    )


# Request-table choices of our own (fixture values, not reference values).
REQUEST_TASKS = ("translation", "sentiment", "poem", "json", "sql", "summary")
REQUEST_MODELS = ("phi3", "llama2", None, "mistral")
REQUEST_LANGUAGES = ("german", "Spanish", "french", None)
REQUEST_OPERATIONS = ("select", "UPDATE", "drop", None)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per conversation turn, with missing and unsupported field
    values spread by fixed expressions over (conv_id, turn)."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("request_id"),
        _pick(REQUEST_TASKS, F.col("conv_id") % 6).alias("task_type"),
        F.when(F.col("turn") % 7 != 3, F.col("text")).alias("text"),
        _pick(REQUEST_LANGUAGES, F.col("turn") % 4).alias("target_language"),
        _pick(REQUEST_MODELS, F.col("conv_id") % 4).alias("model"),
        _pick(REQUEST_OPERATIONS, F.col("turn") % 4).alias("operation"),
        F.when(F.col("conv_id") % 5 != 0, F.lit("2024-01-01")).alias("date"),
        F.when(F.col("conv_id") % 7 != 0, F.lit("{}")).alias("schema_json"),
    )


# Schemas of financial requests, choices of our own: the route's usual one, one with
# limits and a field nobody has, one that wants another type.
FINANCIAL_SCHEMAS = (
    '{"type":"object","required":["date","users"],"properties":{"users":{"type":"array","items":{"type":"object",'
    '"required":["name","salary","expenses"],"properties":{"salary":{"type":"integer","minimum":0}}}}}}',
    '{"type":"object","properties":{"users":{"type":"array","items":{"required":["name","pension"],"properties":'
    '{"salary":{"type":"number","minimum":50000,"maximum":400000},"loans":{"type":"object","additionalProperties":'
    '{"type":"integer","maximum":9000}}}}}}}',
    '{"type":"object","properties":{"date":{"type":"string"},"users":{"items":{"properties":{"salary":{"type":"string"},'
    '"savings":{"minimum":1}}}}}}',
    "{not json",
)


def _grouped(n: Column) -> Column:
    """An amount with one comma before its last three digits."""
    return F.when(n < 1000, n.cast("string")).otherwise(
        F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0")))


def financial_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON-route request per order: prose on the ordering customer's
    segment in one of eight forms, a date that some lack, and a schema."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    n = F.floor(F.col("o_totalprice")).cast("bigint")
    who = F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" Buyer"))
    key = F.col("o_orderkey")

    def said(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    tenth, few = F.floor(n / 10).cast("bigint"), (n % 17000).cast("bigint")
    plain = said(who, " earns ₹", _grouped(n), " a year, spends ₹", _grouped(tenth), ", and invested ₹", _grouped(few), " in Bonds, with savings of ₹5 in cash")
    owing = said("Clerk of ", who, " earns ₹", _grouped(tenth), " and spends ₹10. Owes nothing. The Agent earns ₹", _grouped(n), " or so, spends ₹", _grouped(few),
                 ", has a car loan of ₹", _grouped(few), " and Home loan of ₹7,000, a card debt of ₹12, and a card debt of ₹13")
    forms = (
        said("In short. ", plain, ". ", owing, "."),
        said(owing, ". End of it"),
        said(plain, ". Someone earns ₹", _grouped(n), " and saves"),
        said(who, " earns ₹9 on\nmany days, spends ₹1. ", plain),
        said(who, " earns ₹", _grouped(n), " when Partner earns ₹5 and spends ₹4. ", plain, "\n"),
        said(who, " earns ₹", _grouped(n), " . Later it spends ₹", _grouped(tenth), ". ", owing),
        said("The order of ", who, " is worth ₹", _grouped(n), ". Nobody earns money"),
        said(who, " earns ₹x, but Other earns ₹", _grouped(n), " and spends ₹3"),
    )
    return j.select(
        key.alias("request_id"),
        F.when(key % 5 != 4, F.lit("2024-01-01")).alias("date"),
        F.when(key % 97 != 96, _pick_column(forms, key % 8)).alias("text"),
        F.when(key % 11 != 10, _pick(FINANCIAL_SCHEMAS, F.when(key % 13 == 12, 3).otherwise(key % 3))).alias("schema_json"),
    )


def _pick_column(values, idx: Column) -> Column:
    out = F.when(idx == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(idx == i, v)
    return out
