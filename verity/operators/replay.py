"""Model-call replay and retry selection (J7, U2, U3, U5) as Spark jobs.

A model call is replayed from a table of recorded attempts keyed by request
and ordered by an attempt key. Each retry policy only ever looks at the first
k attempts of a request (k = 2, 7 or 13), so ``row_number() <= k`` is planned
as a WindowGroupLimit: every map task forwards at most k rows per request
before the shuffle, and a request with millions of recorded attempts costs k
rows per task, not its whole history. The choice itself is a partial
aggregation (``min`` over a struct keyed by attempt number).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verity.functions import sqltext as S
from verity.functions import text as T

# FIXED VALUES — the reference's retry limits and give-up message.
# Sentiment: 1 call, up to 6 retries with a suffix, up to 6 plain -> 13 calls.
# Poem: checks on attempts 1-6, line repair from the 4th; the 7th answer is
#   replaced by the message "please try again with next LLM".
SENTIMENT_MAX_CALLS = 13
POEM_MAX_CHECKED = 6
POEM_REPAIR_FROM = 4
POEM_GIVE_UP = "please try again with next LLM"


def first_attempts(attempts: DataFrame, key: str, order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` attempts of each request, numbered 1..k."""
    w = Window.partitionBy(key).orderBy(*order)
    return attempts.withColumn("attempt", F.row_number().over(w)).filter(F.col("attempt") <= k)


def select_sentiment(attempts: DataFrame, key: str = "request_id", order=("ts", "event_id"),
                     response: str = "response") -> DataFrame:
    """The label of the first of the first 13 answers that names a
    sentiment (H17); none -> neutral. ``calls`` = attempts consumed."""
    a = first_attempts(attempts, key, order, SENTIMENT_MAX_CALLS).withColumn(
        "label", T.sentiment_label(F.col(response)))
    g = a.groupBy(key).agg(
        F.min(F.when(F.col("label").isNotNull(), F.struct("attempt", "label"))).alias("_hit"),
        F.max("attempt").alias("_n"),
    )
    return g.select(key, F.coalesce(F.col("_hit.label"), F.lit("neutral")).alias("sentiment"),
                    F.coalesce(F.col("_hit.attempt"), F.col("_n")).alias("calls"))


def select_controlled_sql(first: DataFrame, retry: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Keep the first answer when it passes the validity check (H10),
    else take the retry answer; the kept answer is cleaned (H11) after the
    check, so a fenced first answer always costs a retry. One equi-join on
    the request key (both sides have one row per request)."""
    f = first.select(key, F.col(text).alias("_a1"))
    r = retry.select(key, F.col(text).alias("_a2"))
    j = f.join(r, key, "left")
    valid = S.is_valid_sql("_a1")
    chosen = F.when(valid, F.col("_a1")).otherwise(F.col("_a2"))
    return j.select(key, S.clean_sql(chosen).alias("query"), (~valid).alias("retried"),
                    F.when(~valid & F.col("_a2").isNull(), F.lit("no response")).alias("error"))


def select_poem(attempts: DataFrame, key: str, order: Sequence[str], text: str = "text") -> DataFrame:
    """The first of attempts 1-6 that has exactly 5 non-blank lines; from
    the 4th attempt on, longer answers are cut to their first 5 lines (H19).
    With 7 or more attempts and none valid, the give-up message; with fewer,
    no answer (null)."""
    a = first_attempts(attempts, key, order, POEM_MAX_CHECKED + 1).withColumn(
        "_lines", T.nonblank_lines(text))
    n = F.size("_lines")
    repaired = F.col("attempt") >= POEM_REPAIR_FROM
    valid = (F.col("attempt") <= POEM_MAX_CHECKED) & (
        (n == T.POEM_LINES) | (repaired & (n > T.POEM_LINES)))
    poem = F.when(repaired, T.first_lines("_lines")).otherwise(F.col(text))
    g = a.groupBy(key).agg(F.min(F.when(valid, F.struct("attempt", poem.alias("poem")))).alias("_hit"),
                           F.max("attempt").alias("_n"))
    give_up = F.when(F.col("_n") > POEM_MAX_CHECKED, F.lit(POEM_GIVE_UP))
    return g.select(key, F.coalesce(F.col("_hit.poem"), give_up).alias("poem"),
                    F.coalesce(F.col("_hit.attempt"), F.col("_n")).alias("attempts_used"))
