"""The operators over the given tables, one query each, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm import (codes, exact_dedup, licenses, line_dedup, mixing, near_dedup, negatives, packing, pseudonyms, quality, records,
                        token_counts, toxicity)
from verity.sources.tables import table

TOKENIZER = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``. One of at most 40 words that
    names a licence stands for a licence file: in English at the source's root,
    else in its language's directory."""
    docs = table(spark, sf_dir, "documents")
    short = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) <= 40
    folder = F.when(short & (F.col("lang") == "en"), F.col("source")).otherwise(F.concat_ws("/", "source", "lang"))
    files = docs.select("doc_id", "text", F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"), short.alias("short"))
    return licenses.licensed(files, is_license_file=F.col("short"), carry=["doc_id"])


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a key for tests; production reads it from the job's secrets."""
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), b"verity test key")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op11_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose identifier is divisible by 100; where it is
    divisible by 7 the label is moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.with_label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                                                 F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_pseudonyms": op5_pseudonyms,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_binary_records": op11_binary_records,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}


def _codebook_round(before: str, after: str) -> str:
    """One round over the parts ``q`` (a to d are a part's components)."""
    return f"""
{after}_near AS (
  SELECT q.vec_id, q.p, any_value(q.a) AS a, any_value(q.b) AS b, any_value(q.c) AS c, any_value(q.d) AS d,
         min(64 * ((q.a - k.a) ** 2 + (q.b - k.b) ** 2 + (q.c - k.c) ** 2 + (q.d - k.d) ** 2)::BIGINT + k.i) AS nearest
  FROM q JOIN {before} k ON k.p = q.p GROUP BY q.vec_id, q.p
), {after}_sum AS (
  SELECT p, nearest % 64 AS i, floor(sum(a) / count(*))::BIGINT AS a, floor(sum(b) / count(*))::BIGINT AS b,
         floor(sum(c) / count(*))::BIGINT AS c, floor(sum(d) / count(*))::BIGINT AS d
  FROM {after}_near GROUP BY ALL
), {after} AS (
  SELECT k.p, k.i, coalesce(s.a, k.a) AS a, coalesce(s.b, k.b) AS b, coalesce(s.c, k.c) AS c, coalesce(s.d, k.d) AS d
  FROM {before} k LEFT JOIN {after}_sum s ON s.p = k.p AND s.i = k.i
)"""

ORACLES = {
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
""",
    # Weights 5, 2, 1; caps of three times the source; keys -ln(u) / quality with
    # u from 52 bits of md5(doc_id || 'mix'); whole epochs, then the budget.
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS body FROM documents
), s AS (
  SELECT doc_id, source, md5(body) AS mark, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / (greatest(1, floor(10 * length(regexp_replace(body, '[^\p{L}\x20\x09-\x0D]', '', 'g')) / greatest(length(body), 1)))::DOUBLE / 10) AS key
  FROM d
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM s GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM t WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, cap * left_weight <= weight * left_words AS capped FROM r
), l AS (
  SELECT left_words, left_weight FROM c WHERE NOT capped ORDER BY cap / weight, left_words LIMIT 1
), g AS (
  SELECT c.source, c.source_size,
         CASE WHEN c.capped OR l.left_weight IS NULL THEN c.cap::DOUBLE
              ELSE (c.weight * l.left_words)::DOUBLE / l.left_weight::DOUBLE END AS target
  FROM c LEFT JOIN l ON true
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g
), p AS (
  SELECT s.doc_id, s.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST, s.size, s.mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - ahead)))::BIGINT AS taken FROM p
""",
    "op12_hard_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other_id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
  FROM e AS a JOIN e ON a.vec_id % 100 = 0 AND e.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, other_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INT AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
""",
    "op13_vector_codes": rf"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM v, range(16) AS t(p)
), k0 AS (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS i, a, b, c, d FROM q WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
), {_codebook_round("k0", "k1")}, {_codebook_round("k1", "k2")}, {_codebook_round("k2", "k3")}, told AS (
  SELECT vec_id, string_agg(format('{{:02x}}', nearest % 64), '' ORDER BY p) AS code, sum(nearest // 64)::BIGINT AS error FROM k3_near GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY p, i)) FROM k2) AS codebooks_sha256
FROM told JOIN v USING (vec_id)
""",
}
