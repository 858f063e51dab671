"""Registered queries that answer calls by their content: J7 by prompt, U2 and U3 as
live retries, H19 with its dependent call."""

from __future__ import annotations

from pyspark.sql import functions as F

from verity.functions import prompts as PR
from verity.functions import sqltext as S
from verity.functions import text as T
from verity.operators import poems, responses
from verity.plans import oracle as O
from verity.plans.catalog import register
from verity.plans.q_sqlbench import PROMPTS_SQL, sql_prompts
from verity.session import scratch_folder
from verity.sources import fixtures as X
from verity.sources.tables import table

_MODELS = "[" + ", ".join(O.q(m) for m in X.MODELS) + "]"
_APPROACHES = "[" + ", ".join(O.q(a) for a in X.APPROACHES) + "]"


def _one_of(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


@register("j7_replay_by_prompt", f"""WITH {O.SQL_RESPONSES}, {PROMPTS_SQL},
calls AS (
  SELECT event_id AS call_id, {_MODELS}[event_id % {len(X.MODELS)} + 1] AS model, {_APPROACHES}[event_id // 3 % 4 + 1] AS approach,
         CASE WHEN event_id % 3 = 1 THEN 1 ELSE event_id % 2500 + 1 END AS sample_id FROM events),
store AS (
  SELECT r.model, p.prompt, arg_max({{'response': r.response, 'error': r.error}}, r.sample_id) AS last
  FROM sql_responses r JOIN prompts p USING (sample_id, approach) GROUP BY r.model, p.prompt)
SELECT c.call_id, c.model, sha256(p.prompt) AS prompt_key, s.last.response AS response,
       CASE WHEN p.prompt IS NULL THEN 'no prompt' WHEN s.prompt IS NULL THEN 'no response' ELSE s.last.error END AS error
FROM calls c LEFT JOIN prompts p USING (sample_id, approach) LEFT JOIN store s ON s.model = c.model AND s.prompt = p.prompt""")
def j7_replay_by_prompt(spark, sf_dir):
    """J7 by content: a call for each event, a third of them with one sample's
    prompts, answered by what was last recorded for the same model and prompt."""
    prompts = sql_prompts(spark, sf_dir)
    number = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(
        number.alias("call_id"), _one_of(X.MODELS, number).alias("model"), _one_of(X.APPROACHES, F.floor(number / 3)).alias("approach"),
        F.when(number % 3 == 1, F.lit(1)).otherwise(number % 2500 + 1).alias("sample_id"))
    recorded = X.sql_responses(spark, sf_dir).join(prompts, ["sample_id", "approach"]).select("model", "prompt", "response", "error", "sample_id")
    store = responses.latest_recordings(recorded, "sample_id")
    asked = calls.join(prompts, ["sample_id", "approach"], "left").select("call_id", "model", "prompt")
    told = responses.replayed(asked, store)
    return told.select("call_id", "model", responses.prompt_key(F.col("prompt")).alias("prompt_key"), "response", "error")


def _label_sql(answer: str) -> str:
    return f"""CASE WHEN contains(lower({answer}), 'positive') THEN 'positive' WHEN contains(lower({answer}), 'negative') THEN 'negative'
  WHEN contains(lower({answer}), 'neutral') THEN 'neutral' END"""


@register("u3_live_sentiment", f"""WITH turns AS (
  SELECT conv_id * 100000 + turn AS request_id, 'm' || (conv_id % 2) AS model, coalesce(text, '') AS text FROM conversations),
store AS (
  SELECT model, text, arg_max(['It is Positive', 'no idea', 'hard to say'][request_id % 3 + 1], request_id) AS plain,
         arg_max(['NEGATIVE, then', 'who knows'][request_id % 2 + 1], request_id) AS pressed
  FROM turns GROUP BY model, text)
SELECT t.request_id, coalesce({_label_sql('s.plain')}, {_label_sql('s.pressed')}, 'neutral') AS sentiment,
       CASE WHEN {_label_sql('s.plain')} IS NOT NULL THEN 1 WHEN {_label_sql('s.pressed')} IS NOT NULL THEN 2 ELSE 13 END AS calls
FROM turns t JOIN store s USING (model, text)""")
def u3_live_sentiment(spark, sf_dir):
    """U3 by residual rounds: only turns whose answer names no sentiment are asked again,
    six times with the retry's words and six times without, and count as neutral
    after that. The client is a replay of recordings of both prompts."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("request_id"), F.concat(F.lit("m"), (F.col("conv_id") % 2).cast("string")).alias("model"),
        F.coalesce("text", F.lit("")).alias("text"))
    plain = PR.fill(PR.SENTIMENT_PROMPT, sentence="text")
    pressed = F.concat(plain, F.lit(PR.SENTIMENT_RETRY))
    number = F.col("request_id")
    recorded = turns.select("model", plain.alias("prompt"), _one_of(("It is Positive", "no idea", "hard to say"), number).alias("response"), number.alias("at")).unionByName(
        turns.select("model", pressed.alias("prompt"), _one_of(("NEGATIVE, then", "who knows"), number).alias("response"), number.alias("at")))
    store = responses.latest_recordings(recorded.withColumn("error", F.lit(None).cast("string")), "at")
    label = T.sentiment_label("response")
    told = responses.in_rounds(turns, "request_id", [plain, *[pressed] * 6, *[plain] * 6], label.isNotNull(),
                               lambda calls: responses.replayed(calls, store), scratch_folder(spark, "sentiment"), repeatable=True)
    return told.select("request_id", F.coalesce(label, F.lit("neutral")).alias("sentiment"), "calls")


@register("u2_live_controlled_sql", f"""WITH {O.SQL_RESPONSES}, {PROMPTS_SQL},
a AS (SELECT p.sample_id, p.prompt, r.response AS first, q.query AS second FROM prompts p
      JOIN sql_responses r ON r.sample_id = p.sample_id AND r.approach = 'controlled' AND r.model = 'm0'
      JOIN corpus q ON q.sample_id = p.sample_id WHERE p.approach = 'controlled'),
s AS (SELECT prompt, arg_max(first, sample_id) AS first, arg_max(second, sample_id) AS second FROM a GROUP BY prompt),
v AS (SELECT a.sample_id, s.first, s.second,
             ends_with({O.strip('s.first')}, ';') AND regexp_matches(upper(s.first), 'SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER')
             AND (NOT contains(upper(s.first), 'CREATE TABLE') OR contains(s.first, '('))
             AND (NOT regexp_matches(upper(s.first), 'UPDATE|DELETE') OR contains(upper(s.first), 'WHERE')) AS valid
      FROM a JOIN s USING (prompt))
SELECT sample_id, CASE WHEN valid THEN first ELSE second END AS response, CASE WHEN valid THEN 1 ELSE 2 END AS calls FROM v""")
def u2_live_controlled_sql(spark, sf_dir):
    """U2 by residual rounds: the controlled prompt of every sample, and once more with the
    retry's words where the answer is no valid SQL; the second answer stands."""
    samples = sql_prompts(spark, sf_dir).where(F.col("approach") == "controlled").select("sample_id", F.lit("m0").alias("model"), F.col("prompt").alias("asked"))
    again = F.concat("asked", F.lit(PR.CONTROLLED_RETRY))
    answers = X.sql_responses(spark, sf_dir).where("model = 'm0' and approach = 'controlled'").select("sample_id", "response")
    none = F.lit(None).cast("string").alias("error")
    first = samples.join(answers, "sample_id").select("model", F.col("asked").alias("prompt"), "response", none, "sample_id")
    second = samples.join(X.corpus(spark, sf_dir).select("sample_id", "query"), "sample_id").select("model", again.alias("prompt"), F.col("query").alias("response"), none, "sample_id")
    store = responses.latest_recordings(first.unionByName(second), "sample_id")
    told = responses.in_rounds(samples, "sample_id", [F.col("asked"), again], S.is_valid_sql("response"),
                               lambda calls: responses.replayed(calls, store), scratch_folder(spark, "sql"), repeatable=True)
    return told.select("sample_id", "response", "calls")


_LINES = f"list_filter(string_split(text, chr(10)), lambda l: {O.strip('l')} <> '')"


@register("h19_u5_poem_append", f"""WITH turns AS (
  SELECT conv_id, turn, regexp_replace(text, '[.!?] +', chr(10), 'g') AS text FROM conversations WHERE role = 'assistant'),
l AS (SELECT conv_id, turn, text, {_LINES} AS lines FROM turns),
a AS (SELECT conv_id, turn, lines, 5 - len(lines) AS diff, coalesce(lines[-1], '') AS last FROM l WHERE text IS NOT NULL),
s AS (SELECT diff, last, count(*) FILTER (WHERE conv_id % 4 <> 0) > 0 AS known FROM a GROUP BY diff, last)
SELECT a.conv_id, a.turn, len(a.lines) < 5 AS asked,
       array_to_string((CASE WHEN len(a.lines) < 5 AND s.known THEN list_append(a.lines, 'after ' || a.last) ELSE a.lines END)[1:5], chr(10)) AS poem,
       CASE WHEN len(a.lines) < 5 AND NOT s.known THEN 'no response' END AS error
FROM a JOIN s USING (diff, last)""")
def h19_u5_poem_append(spark, sf_dir):
    """Answers of any length brought to five lines; a short one gets the first
    line of what is recorded for the prompt made from its own last line."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null").select(
        "conv_id", "turn", F.lit("m0").alias("model"), F.regexp_replace("text", "[.!?] +", "\n").alias("text"))
    lines = T.nonblank_lines("text")
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    recorded = turns.where("conv_id % 4 <> 0").select(
        "model", PR.fill(PR.POEM_APPEND, diff=T.POEM_LINES - F.size(lines), line=last).alias("prompt"),
        F.concat(F.lit("after "), last, F.lit("\nand more")).alias("response"), F.lit(None).cast("string").alias("error"), F.col("turn").alias("at"))
    store = responses.latest_recordings(recorded, "at")
    told = poems.five_lines(turns, "text", lambda calls: responses.replayed(calls, store))
    return told.select("conv_id", "turn", "asked", "poem", "error")
