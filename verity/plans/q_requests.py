"""Registered request-side queries: P1-P5, S1, S1b, S9/W4, S10, S12 and the
replayed retry policies U2, U3, U5."""

from __future__ import annotations

from pyspark.sql import functions as F

from verity.functions import sqltext as S
from verity.operators import replay as RP
from verity.operators import requests as RQ
from verity.plans import oracle as O
from verity.plans.catalog import register
from verity.sources import fixtures as X
from verity.sources.tables import table

_R = f"WITH {O.REQUESTS}"


@register("p1_required_fields", f"""{_R}
SELECT request_id, CASE WHEN len(m) > 0 THEN 'Missing required fields: ' || array_to_string(m, ', ') END AS error,
       CASE WHEN len(m) > 0 THEN 400 END AS code
FROM (SELECT request_id, list_filter([CASE WHEN text IS NULL THEN 'text' END, CASE WHEN date IS NULL THEN 'date' END,
      CASE WHEN schema_json IS NULL THEN 'schema' END], lambda x: x IS NOT NULL) AS m FROM requests WHERE task_type = 'json')""")
def p1_required_fields(spark, sf_dir):
    """P1 on the JSON route: missing fields listed, code 400."""
    r = X.requests(spark, sf_dir).filter(F.col("task_type") == "json")
    err = RQ.missing_fields()
    return r.select("request_id", err.alias("error"), F.when(err.isNotNull(), F.lit(400)).alias("code"))


@register("p2_p5_defaults_and_support", f"""{_R}
SELECT request_id, coalesce(model, 'phi3') AS model, coalesce(target_language, 'german') AS target_language,
       coalesce(operation, 'select') AS operation,
       lower(coalesce(operation, 'select')) IN {tuple(S.SQL_OPERATIONS)} AS operation_supported,
       lower(coalesce(target_language, 'german')) IN ('german', 'spanish') AS language_supported
FROM requests""")
def p2_p5_defaults_and_support(spark, sf_dir):
    r = RQ.with_defaults(X.requests(spark, sf_dir))
    return r.select("request_id", "model", "target_language", "operation",
                    RQ.is_supported_operation(F.col("operation")).alias("operation_supported"),
                    RQ.is_supported_language(F.col("target_language")).alias("language_supported"))


_ROUTE_SQL = "CASE task_type " + " ".join(f"WHEN {O.q(t)} THEN {O.q(c)}" for t, c in RQ.ROUTES) + " END"


@register("p3_p4_route_and_envelope", f"""{_R},
d AS (SELECT *, coalesce(target_language, 'german') AS lang FROM requests),
b AS (SELECT request_id, task_type, {_ROUTE_SQL} AS controller,
             CASE WHEN task_type = 'translation' AND lower(lang) NOT IN ('german', 'spanish')
                  THEN 'Unsupported language: ' || lower(lang) || '. Supported languages: [''german'', ''spanish'']'
                  ELSE text END AS body FROM d)
SELECT request_id, controller,
       CASE WHEN controller IS NULL THEN 'Unknown controller name: ' || task_type END AS route_error,
       CASE WHEN controller IS NULL OR body IS NULL OR starts_with(body, 'Error') THEN 'error' ELSE 'success' END AS status,
       CASE WHEN controller IS NULL OR body IS NULL OR starts_with(body, 'Error') THEN 500 ELSE 200 END AS code
FROM b""")
def p3_p4_route_and_envelope(spark, sf_dir):
    """P4 routing by task type and the P3 envelope; as in the reference, a
    translation error is recognised only by an 'Error' prefix, so the
    unsupported-language message comes back as a success."""
    r = RQ.with_defaults(X.requests(spark, sf_dir))
    controller = RQ.route(F.col("task_type"))
    body = F.when((F.col("task_type") == "translation") & ~RQ.is_supported_language(F.col("target_language")),
                  RQ.unsupported_language_message(F.col("target_language"))).otherwise(F.col("text"))
    b = r.select("request_id", "task_type", controller.alias("controller"), body.alias("body"))
    bad = F.col("controller").isNull() | F.col("body").isNull() | F.col("body").startswith("Error")
    return b.select(
        "request_id", "controller",
        F.when(F.col("controller").isNull(), F.concat(F.lit("Unknown controller name: "), F.col("task_type")))
        .alias("route_error"),
        F.when(bad, F.lit("error")).otherwise(F.lit("success")).alias("status"),
        F.when(bad, F.lit(500)).otherwise(F.lit(200)).alias("code"))


REGISTRY = (("m0", "phi3"), ("m1", "llama2"))


@register("s1_registry_lookup", f"""{O.RUNS.join(['WITH ', ''])},
reg(model_key, model_name) AS (VALUES {', '.join(f"({O.q(k)}, {O.q(v)})" for k, v in REGISTRY)})
SELECT r.model AS model, coalesce(g.model_name, r.model) AS model_name, count(*) AS n_rows
FROM runs r LEFT JOIN reg g ON g.model_key = r.model GROUP BY 1, 2""")
def s1_registry_lookup(spark, sf_dir):
    """Key -> model name, falling back to the key; aggregated per model
    first so the lookup joins one row per model."""
    counts = X.runs(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))
    j = RQ.lookup_model(counts, RQ.registry(spark, REGISTRY))
    return j.select("model", "model_name", "n_rows")


STRICT_REGISTRY = (("phi3", "phi3:latest"), ("llama2", "llama2:7b"))


@register("s1b_strict_lookup", f"""{_R},
reg(model_key, model_name) AS (VALUES {', '.join(f"({O.q(k)}, {O.q(v)})" for k, v in STRICT_REGISTRY)})
SELECT r.request_id, g.model_name, CASE WHEN g.model_name IS NULL THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN g.model_name IS NULL THEN 0 END AS tokens_used
FROM requests r LEFT JOIN reg g ON g.model_key = coalesce(r.model, 'phi3')""")
def s1b_strict_lookup(spark, sf_dir):
    """An unknown model fails the request with 0 tokens."""
    r = RQ.with_defaults(X.requests(spark, sf_dir)).select("request_id", "model")
    j = RQ.lookup_model(r, RQ.registry(spark, STRICT_REGISTRY), strict=True)
    miss = F.col("model_name").isNull()
    return j.select("request_id", "model_name", F.when(miss, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
                    F.when(miss, F.lit(0)).alias("tokens_used"))


@register("s9_w4_latest_run_per_kind", """SELECT event_type AS kind, max(strftime(ts, '%Y%m%d_%H%M%S')) AS latest_run_id
FROM events GROUP BY event_type""")
def s9_w4_latest_run_per_kind(spark, sf_dir):
    """Newest run id per artefact kind, from the run's time (never
    a file time); one row a kind is formatted, after the max."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("kind")).agg(
        F.max("ts").alias("last")).select("kind", F.date_format("last", "yyyyMMdd_HHmmss").alias("latest_run_id"))


_STATUS = (("view", "running"), ("click", "running"), ("signup", "running"), ("purchase", "completed"),
           ("error", "failed"))
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in _STATUS) + " END"


@register("s10_run_ledger", f"""SELECT job_id, status, status = 'completed' AS results_available FROM (
  SELECT user_id AS job_id, {_STATUS_SQL} AS status,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def s10_run_ledger(spark, sf_dir):
    """Status events per job; the latest state by (ts, event_id); results
    only for completed jobs."""
    ev = table(spark, sf_dir, "events")
    m = F.create_map(*[F.lit(x) for kv in _STATUS for x in kv])
    s = RQ.latest_status(ev, "user_id", m[F.col("event_type")], ["ts", "event_id"])
    return s.select(F.col("user_id").alias("job_id"), "status",
                    (F.col("status") == "completed").alias("results_available"))


@register("s12_json_parse", """SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS BIGINT)
END AS k FROM events""")
def s12_json_parse(spark, sf_dir):
    """Parse JSON request bodies with a schema; malformed -> null."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("s12_malformed_bodies", """WITH b AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN replace(props, ': ', ': "x') || '"'
       WHEN 2 THEN replace(replace(props, ': ', ': "v'), '}', '"}') WHEN 3 THEN '[' || props || ']' WHEN 4 THEN CASE WHEN event_id % 2 = 0 THEN '' END ELSE props END AS body FROM events),
j AS (SELECT event_id, body, CASE WHEN json_valid(body) THEN body END AS good FROM b)
SELECT event_id, CASE WHEN json_type(good) = 'OBJECT' THEN TRY_CAST(json_extract(good, '$.k') AS BIGINT) END AS k,
       CASE WHEN body IS NULL THEN 'missing body' WHEN good IS NULL THEN 'malformed JSON' WHEN json_type(good) <> 'OBJECT' THEN 'not an object'
            WHEN json_type(good, '$.k') = 'VARCHAR' THEN 'wrong type' END AS error FROM j""")
def s12_malformed_bodies(spark, sf_dir):
    """Event bodies, most of them truncated, broken, of another type, in a
    list, empty or missing: each with its value or its error."""
    props, n = F.col("props"), F.col("event_id")
    body = (F.when(n % 7 == 0, F.left(props, F.length(props) - 1))
            .when(n % 7 == 1, F.concat(F.replace(props, F.lit(": "), F.lit(': "x')), F.lit('"')))
            .when(n % 7 == 2, F.replace(F.replace(props, F.lit(": "), F.lit(': "v')), F.lit("}"), F.lit('"}')))
            .when(n % 7 == 3, F.concat(F.lit("["), props, F.lit("]")))
            .when(n % 7 == 4, F.when(n % 2 == 0, F.lit(""))).otherwise(props))
    out = RQ.parse_bodies(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", "k bigint")
    return out.select("event_id", F.col("parsed.k").alias("k"), "error")


# --- replayed retry policies ---------------------------------------------------
_LABEL_SQL = ("CASE WHEN contains(lower(response), 'positive') THEN 'positive' "
              "WHEN contains(lower(response), 'negative') THEN 'negative' "
              "WHEN contains(lower(response), 'neutral') THEN 'neutral' END")


@register("u3_sentiment_attempts", f"""WITH {O.ATTEMPTS},
a AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS attempt FROM attempts),
l AS (SELECT *, {_LABEL_SQL} AS label FROM a WHERE attempt <= 13)
SELECT request_id, coalesce(arg_min(label, attempt) FILTER (WHERE label IS NOT NULL), 'neutral') AS sentiment,
       coalesce(min(attempt) FILTER (WHERE label IS NOT NULL), max(attempt)) AS calls
FROM l GROUP BY request_id""")
def u3_sentiment_attempts(spark, sf_dir):
    """U3 over recorded attempts (one event = one call of request user_id)."""
    return RP.select_sentiment(X.attempts(spark, sf_dir))


@register("u2_controlled_sql_attempts", f"""WITH {O.SQL_PAIRS},
j AS (SELECT a.sample_id, a.generated AS a1, b.generated AS a2
      FROM sql_pairs a LEFT JOIN sql_pairs b ON b.sample_id = a.sample_id AND b.approach = 'controlled'
      WHERE a.approach = 'raw'),
v AS (SELECT *, {'(ends_with(' + O.strip('a1') + ", ';') AND (" + ' OR '.join(f"contains(upper(a1), {O.q(op.upper())})" for op in S.SQL_OPERATIONS) + ") AND (NOT contains(upper(a1), 'CREATE TABLE') OR contains(a1, '(')) AND (NOT (contains(upper(a1), 'UPDATE') OR contains(upper(a1), 'DELETE')) OR contains(upper(a1), 'WHERE')))"} AS valid FROM j)
SELECT sample_id, {O.strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN valid THEN a1 ELSE a2 END, '^```sql' || chr(10), ''), '^```' || chr(10), ''), chr(10) || '```$', ''), chr(10), ' ', 'g')")} AS query,
       NOT valid AS retried, CASE WHEN NOT valid AND a2 IS NULL THEN 'no response' END AS error
FROM v""")
def u2_controlled_sql_attempts(spark, sf_dir):
    """First answer = the raw approach's text, retry = the controlled
    approach's text of the same sample."""
    p = X.sql_pairs(spark, sf_dir).select("sample_id", "approach", F.col("generated").alias("text"))
    return RP.select_controlled_sql(p.filter(F.col("approach") == "raw"),
                                    p.filter(F.col("approach") == "controlled"), "sample_id")


@register("u5_poem_attempts", f"""WITH a AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt
  FROM conversations WHERE role = 'assistant'),
b AS (SELECT *, list_filter(string_split(text, chr(10)), lambda l: {O.strip('l')} <> '') AS lines FROM a WHERE attempt <= 7),
c AS (SELECT *, attempt <= 6 AND (len(lines) = 5 OR (attempt >= 4 AND len(lines) > 5)) AS valid,
             CASE WHEN attempt >= 4 THEN array_to_string(lines[1:5], chr(10)) ELSE text END AS poem FROM b)
SELECT conv_id, coalesce(arg_min(poem, attempt) FILTER (WHERE valid),
         CASE WHEN max(attempt) > 6 THEN 'please try again with next LLM' END) AS poem,
       coalesce(min(attempt) FILTER (WHERE valid), max(attempt)) AS attempts_used
FROM c GROUP BY conv_id""")
def u5_poem_attempts(spark, sf_dir):
    """The assistant turns of a conversation are the successive poem
    attempts of one request."""
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return RP.select_poem(conv.select("conv_id", "turn", "text"), "conv_id", ["turn"])


@register("u6_u8_request_dispatch")
def u6_u8_request_dispatch(spark, sf_dir):
    """Every request routed to its controller (translation, sentiment,
    JSON, SQL, poem; unknown -> error), with output, status and tokens (echo
    answers stand in for the model). Rows-only: the JSON branch uses the
    look-ahead block pattern; each branch is oracle-checked on its own."""
    from verity.operators.dispatch import dispatch
    return dispatch(X.requests(spark, sf_dir))
