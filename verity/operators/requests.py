"""Request handling as column logic (P1-P5, S1, S1b, S10, S12): one request
per row, validation, defaults, routing and registry lookup are projections
and small broadcast joins; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.functions import sqltext as S

# FIXED VALUES — defaults, supported sets and routing of the reference.
# Defaults: model phi3, target_language german, operation select.
# Supported languages: german, spanish. Supported operations: select, insert,
#   update, delete, create, alter.
# Routing: translation -> TranslationController, sentiment ->
#   SentimentController, poem -> PoemController, json -> JSONController,
#   sql -> SQLController; anything else is an error
#   "Unknown controller name: <name>".
# Required fields of the JSON route: text, date, schema.
DEFAULTS = (("model", "phi3"), ("target_language", "german"), ("operation", "select"))
LANGUAGES = ("german", "spanish")
ROUTES = (("translation", "TranslationController"), ("sentiment", "SentimentController"),
          ("poem", "PoemController"), ("json", "JSONController"), ("sql", "SQLController"))
JSON_REQUIRED = (("text", "text"), ("date", "date"), ("schema", "schema_json"))


def missing_fields(required: Sequence[tuple[str, str]] = JSON_REQUIRED) -> Column:
    """Comma-separated names of absent required fields (null if none)."""
    names = F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for n, c in required])
    present = F.filter(names, lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(present, ", ")))


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill absent request fields with the route defaults."""
    for c, v in DEFAULTS:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return df


def route(task: Column) -> Column:
    """Controller name for a task type; null for an unknown one."""
    out = F
    for t, c in ROUTES:
        out = out.when(task == t, F.lit(c))
    return out


def is_supported_operation(op: Column) -> Column:
    """P5: lower-cased operation in the six statement kinds."""
    return F.lower(op).isin(list(S.SQL_OPERATIONS))


def is_supported_language(lang: Column) -> Column:
    """P5: lower-cased language in the two supported ones."""
    return F.lower(lang).isin(list(LANGUAGES))


def unsupported_language_message(lang: Column) -> Column:
    listed = ", ".join(f"'{x}'" for x in LANGUAGES)
    return F.concat(F.lit("Unsupported language: "), F.lower(lang), F.lit(f". Supported languages: [{listed}]"))


def registry(spark: SparkSession, entries: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(entries), "model_key string, model_name string")


def lookup_model(df: DataFrame, reg: DataFrame, key: str = "model", strict: bool = False) -> DataFrame:
    """Attach ``model_name`` from the registry. Lenient: an unknown
    key maps to itself. Strict: it stays null (the caller fails the request).
    The registry carries no hint: the planner broadcasts it by measured bytes."""
    j = df.join(reg, F.col(key) == reg.model_key, "left").drop("model_key")
    if strict:
        return j
    return j.withColumn("model_name", F.coalesce(F.col("model_name"), F.col(key)))


def latest_status(events: DataFrame, key: str, status: Column, order: Sequence[str]) -> DataFrame:
    """Latest status per job = ``max_by(status, order)`` (a partial
    aggregation, no window over a job's whole history)."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))


def available_models(reg: DataFrame) -> DataFrame:
    """The registry's model keys."""
    return reg.select("model_key")


def parse_bodies(df: DataFrame, body: str, fields: str, out: str = "parsed") -> DataFrame:
    """Request bodies read with a schema (``fields``, as in ``from_json``);
    a body that cannot be read is a row with an ``error``, never a failed job.
    Errors, in this order: a null body, one that is not JSON (broken, truncated,
    empty), one that is no object, one with a value of another type; fields
    that can be read are kept in the last case. Absent fields are null."""
    text = F.col(f"`{body}`")
    read = F.from_json(text, f"{fields}, _unread string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    rows = df.withColumn("_read", read)
    error = (F.when(text.isNull(), "missing body").when(F.try_parse_json(text).isNull(), "malformed JSON")
             .when(~F.ltrim(text).startswith("{"), "not an object").when(F.col("_read._unread").isNotNull(), "wrong type"))
    kept = F.when(error.isNull() | (error == "wrong type"), F.col("_read").dropFields("_unread"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], kept.alias(out), error.alias("error"))
