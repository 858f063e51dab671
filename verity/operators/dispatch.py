"""Request dispatch. Every request row is routed by task type (P4) to
its controller's logic, all as one projection: each branch sits inside a
``when(task == ...)`` so a row only evaluates its own controller's
expressions. Failures give (null output, 0 tokens), as the reference's
``generate_response`` does. Model answers come from a Column function
(default: echo), so the same plan runs on replayed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.functions import records as R
from verity.functions import sqltext as S
from verity.functions import text as T
from verity.operators import requests as RQ


def dispatch(requests: DataFrame, answer=None) -> DataFrame:
    """Columns out: request_id, controller, output, status, tokens_used."""
    ans = answer or (lambda c: c)
    r = RQ.with_defaults(requests)
    task, text = F.col("task_type"), F.col("text")
    staged = r.select(
        "*",
        RQ.route(task).alias("controller"),
        F.when(task.isin("translation", "sentiment"), T.split_sentences(text)).alias("_sent"),
        F.when(task == "json", R.user_blocks(text)).alias("_found"),
    )
    lang_ok = RQ.is_supported_language(F.col("target_language"))
    op_ok = RQ.is_supported_operation(F.col("operation"))
    joined_in = T.token_count(F.array_join("_sent", ""))
    translated = T.reassemble_expr(F.transform("_sent", lambda s: T.clean_translation(ans(s))))
    sent_labels = F.transform("_sent", lambda s: F.coalesce(T.sentiment_label(ans(s)), F.lit("neutral")))
    counts = F.to_json(F.struct(
        F.size(F.filter(sent_labels, lambda x: x == "positive")).alias("positive"),
        F.size(F.filter(sent_labels, lambda x: x == "negative")).alias("negative"),
        F.size(F.filter(sent_labels, lambda x: x == "neutral")).alias("neutral")))
    users = R.users_from("_found")
    sql_out = S.clean_sql(ans(text))
    poem_kw = T.keywords(text)
    poem = ans(text)
    output = (
        F.when(text.isNull() | F.col("controller").isNull(), F.lit(None))
        .when(task == "translation", F.when(lang_ok, translated).otherwise(
            RQ.unsupported_language_message(F.col("target_language"))))
        .when(task == "sentiment", counts)
        .when(task == "json", F.when(~R.missing_spends("_found") & F.col("date").isNotNull(),
                                     F.to_json(F.struct(F.col("date"), users.alias("users")))))
        .when(task == "sql", F.when(op_ok, sql_out))
        .when(task == "poem", poem)
    )
    tokens = (
        F.when(output.isNull(), F.lit(0))
        .when(task == "translation", F.when(lang_ok, joined_in + T.token_count(translated)).otherwise(0))
        .when(task == "sentiment", joined_in + T.token_count(F.lit(T.SENTIMENT_RESPONSE)))
        .when(task == "json", R.input_tokens(text) + R.output_tokens(F.col("date"), users))
        .when(task == "sql", T.token_count(text) + T.token_count(sql_out))
        .when(task == "poem", T.token_count(F.array_join(poem_kw, "")) + T.token_count(poem))
    )
    status = F.when(output.isNull(), F.lit("error")).when(output.startswith("Error"), F.lit("error")).otherwise(
        F.lit("success"))
    return staged.select("request_id", "controller", output.alias("output"), status.alias("status"),
                         tokens.cast("bigint").alias("tokens_used"))
