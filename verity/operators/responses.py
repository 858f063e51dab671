"""A content-addressed store of model calls, and calls answered from it.

A call is known by its content, the model and the prompt; a recording is found by
(model, SHA-256 of the prompt) and the prompts themselves are compared on a hit, so
two prompts that share a hash are never mixed up. Of several recordings of one call
the latest counts.

A prompt may hold a third of all calls. Keys with at least one in ``HOT`` of all calls are
at most ``HOT`` many whatever the input, and their recordings, one a key, are
broadcast; all other calls meet theirs in a shuffle join in which no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.operators.inference import persist_responses

HOT = 200
Answer = Callable[[DataFrame], DataFrame]


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def latest_recordings(recorded: DataFrame, order: str) -> DataFrame:
    """One row per (model, prompt): the ``response`` and ``error`` recorded last by
    ``order`` (ties: the greater response). Combined map-side."""
    last = F.max(F.struct(F.col(order), F.col("response"), F.col("error"))).alias("last")
    return recorded.where("prompt is not null").groupBy("model", prompt_key(F.col("prompt")).alias("prompt_key"), "prompt").agg(last).select(
        "model", "prompt_key", "prompt", "last.response", "last.error")


def replayed(calls: DataFrame, store: DataFrame) -> DataFrame:
    """``calls`` (with columns ``model`` and ``prompt``) and the ``response`` and
    ``error`` that the store has for them: 'no prompt' for a null prompt, 'no
    response' where there is no recording. ``store``: see ``latest_recordings``."""
    keyed = calls.withColumn("prompt_key", prompt_key(F.col("prompt")))
    counts = keyed.where("prompt is not null").groupBy("model", "prompt_key").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    hot = counts.join(F.broadcast(total), F.col("n") * HOT >= F.col("total")).select("model", "prompt_key", F.lit(True).alias("hot"))  # HOT rows at most
    marked = keyed.join(F.broadcast(hot), ["model", "prompt_key"], "left")
    kept = store.select(F.col("model").alias("_model"), F.col("prompt_key").alias("_key"), F.col("prompt").alias("_prompt"), "response", "error", F.lit(True).alias("_hit"))
    named = hot.select(F.col("model").alias("_model"), F.col("prompt_key").alias("_key"))
    few = F.broadcast(kept.join(F.broadcast(named), ["_model", "_key"], "left_semi"))  # one row a hot key and prompt
    same = F.col("model").eqNullSafe(F.col("_model")) & (F.col("prompt_key") == F.col("_key")) & (F.col("prompt") == F.col("_prompt"))
    columns = [F.col(f"`{c}`") for c in calls.columns] + ["response", "error", "_hit"]
    found = marked.where("hot").join(few, same, "left").select(columns).unionByName(marked.where("hot is null").join(kept, same, "left").select(columns))
    error = F.when(F.col("prompt").isNull(), "no prompt").when(F.col("_hit").isNull(), "no response").otherwise(F.col("error"))
    return found.withColumn("error", error).drop("_hit")


def in_rounds(requests: DataFrame, key: str, prompts: Sequence[Column], accepted: Column, answer: Answer, folder: str,
              repeatable: bool = False) -> DataFrame:
    """U2, U3 and U5 as live retries: every request gets the first prompt, and only those
    whose ``response`` is not ``accepted`` go to the next round with the next
    prompt, until none is left or the prompts are used up. Each round is written
    below ``folder`` before it is looked at, so no call is made twice.

    ``answer`` adds ``response`` and ``error`` to rows with ``model`` and ``prompt``: a
    replay from the store, or ``inference.generate`` with a client. A ``repeatable`` one
    says the same to the same prompt: rounds that repeat a prompt are counted, not made.

    Returns ``key``, ``response`` (the accepted one, else the last), ``error``, ``calls``
    and ``accepted``."""
    spark, left, told, asked = requests.sparkSession, requests, [], []
    for number, prompt in enumerate(prompts, 1):
        if repeatable and str(prompt) in asked:
            continue
        asked.append(str(prompt))
        made = answer(left.withColumn("prompt", prompt)).withColumn("accepted", F.coalesce(accepted, F.lit(False)))
        done = persist_responses(spark, made.select(*requests.columns, "response", "error", "accepted"), f"{folder}/round{number}")
        told.append(done.where("accepted").select(key, "response", "error", F.lit(number).alias("calls"), "accepted"))
        left = done.where("not accepted").select(*requests.columns)
        if left.isEmpty():
            break
    told.append(done.where("not accepted").select(key, "response", "error", F.lit(len(prompts)).alias("calls"), "accepted"))
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out
