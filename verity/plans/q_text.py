"""Registered text-response queries over whole ``documents`` and
``conversations`` texts: H12-H20, H24-H25, A12, A24, J6/H15, U4.

Everything is per-row (array functions over a staged sentence/line array)
except the English-word filter, which explodes words against a dictionary
table; no query here shuffles the text except that one."""

from __future__ import annotations

from pyspark.sql import functions as F

from verity.functions import text as T
from verity.operators import textops
from verity.plans import oracle as O
from verity.plans.catalog import register
from verity.sources import fixtures as X
from verity.sources.tables import table

NL = "chr(10)"


def _sentences_sql(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"


def _label_sql(x: str) -> str:
    return (f"CASE WHEN contains(lower({x}), 'positive') THEN 'positive' WHEN contains(lower({x}), 'negative') "
            f"THEN 'negative' WHEN contains(lower({x}), 'neutral') THEN 'neutral' END")


def _nonblank_sql(x: str) -> str:
    return f"list_filter(string_split({x}, {NL}), lambda l: {O.strip('l')} <> '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@register("h16_sentence_split", f"""SELECT doc_id, len({_sentences_sql('text')}) AS n_sentences FROM documents""")
def h16_sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.split_sentences("text")).alias("n_sentences"))


@register("h24_h28_word_counts", f"SELECT doc_id, {O.wc('text')} AS n_words FROM documents")
def h24_h28_word_counts(spark, sf_dir):
    """H24 default token count / H28 input length: whitespace words."""
    return _docs(spark, sf_dir).select("doc_id", T.token_count("text").alias("n_words"))


@register("a12_a24_sentiment_counts", f"""WITH s AS (SELECT doc_id, {_sentences_sql('text')} AS sentences FROM documents),
l AS (SELECT doc_id, sentences, list_transform(sentences, lambda x: coalesce({_label_sql('x')}, 'neutral')) AS labels
      FROM s)
SELECT doc_id, len(list_filter(labels, lambda v: v = 'positive')) AS positive,
       len(list_filter(labels, lambda v: v = 'negative')) AS negative,
       len(list_filter(labels, lambda v: v = 'neutral')) AS neutral,
       {O.wc("array_to_string(sentences, '')")} + {O.wc(O.q(T.SENTIMENT_RESPONSE))} AS tokens_used
FROM l""")
def a12_a24_sentiment_counts(spark, sf_dir):
    """A12 + H17 + A24: per text, sentence labels counted by class, with the
    token accounting of the sentiment call (sentences joined with no
    separator, plus the joined label names). Each sentence is labelled from
    its own text (a lexical stand-in for the model's answer; with recorded
    answers, label those instead, see ``verity.operators.replay``)."""
    return textops.sentiment_counts(_docs(spark, sf_dir), "doc_id", "text")


def _clean_translation_sql(x: str) -> str:
    t = f"regexp_replace({x}, '^```.*?' || {NL}, '')"
    t = f"regexp_replace({t}, {NL} || '```$', '')"
    for pat in T.TRANSLATION_NOISE:
        p = pat.replace("(?diu)", "(?i)")
        t = f"regexp_replace({t}, {O.q(p)}, '', 'g')"
    lines = f"list_filter(string_split({t}, {NL}), lambda ln: length({O.strip('ln')}) > {T.MIN_LINE_CHARS})"
    return O.strip(O.rre(f"array_to_string({lines}, ' ')", r"\s+", " "))


@register("h12_h13_clean_translation", f"""WITH {O.RECORDED}
SELECT conv_id, turn, {_clean_translation_sql('response')} AS cleaned,
       replace(replace(replace(response, '"', ''), '''', ''), ':', '') AS without_quotes
FROM recorded_responses WHERE response IS NOT NULL""")
def h12_h13_clean_translation(spark, sf_dir):
    """H12 clean-up and H13 quote removal of every recorded answer."""
    r = X.recorded_responses(spark, sf_dir).filter(F.col("response").isNotNull())
    return r.select("conv_id", "turn", T.clean_translation("response").alias("cleaned"),
                    T.remove_extra("response").alias("without_quotes"))


@register("t4_h18_h19_line_checks", f"""WITH l AS (SELECT doc_id, {_nonblank_sql('text')} AS lines FROM documents)
SELECT doc_id, len(lines) AS n_lines, len(lines) = 5 AS is_five_lines,
       array_to_string(lines[1:5], {NL}) AS first_five FROM l""")
def t4_h18_h19_line_checks(spark, sf_dir):
    """H18 five-line check, T4/H19 truncation to the first five lines."""
    d = _docs(spark, sf_dir).select("doc_id", T.nonblank_lines("text").alias("lines"))
    return d.select("doc_id", F.size("lines").alias("n_lines"), (F.size("lines") == T.POEM_LINES).alias("is_five_lines"),
                    T.first_lines("lines").alias("first_five"))


@register("h20_keyword_split", f"""WITH k AS (SELECT doc_id, list_transform(string_split(text, ','), lambda x: lower(x)) AS kw
FROM documents)
SELECT doc_id, len(kw) AS n_keywords, array_to_string(kw, '|') AS keywords FROM k""")
def h20_keyword_split(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.keywords("text").alias("kw"))
    return d.select("doc_id", F.size("kw").alias("n_keywords"), F.array_join("kw", "|").alias("keywords"))


def _ends_sql(x: str) -> str:
    return " OR ".join(f"ends_with({x}, {O.q(e)})" for e in T.SENTENCE_ENDINGS)


@register("u4_h25_translate_replay", f"""WITH s AS (SELECT doc_id, {_sentences_sql('text')} AS sentences FROM documents),
t AS (SELECT doc_id, sentences, list_transform(sentences, lambda x: {_clean_translation_sql('x')}) AS pieces FROM s),
j AS (SELECT doc_id, sentences, array_to_string(list_transform(pieces, lambda p: CASE WHEN {_ends_sql('p')} THEN p
      ELSE p || '.' END), '') AS translation FROM t)
SELECT doc_id, translation, {O.wc("array_to_string(sentences, '')")} + {O.wc('translation')} AS tokens_used FROM j""")
def u4_h25_translate_replay(spark, sf_dir):
    """U4: translate sentence by sentence, clean each piece (H12) and
    reassemble in order (H25), with token accounting. The model answer is
    replayed; here the echo answer (the sentence itself) stands in."""
    return textops.translate_sentences(_docs(spark, sf_dir), "doc_id", "text")


_LETTERS_SQL = "regexp_replace({x}, '[^a-zA-ZäöüÄÖÜß\\s]', '', 'g')"


@register("j6_h15_english_word_filter", f"""WITH dict AS (
  SELECT list(DISTINCT lower(w)) AS ws FROM benchmark, unnest({O.words(_LETTERS_SQL.format(x='text'))}) AS t(w))
SELECT doc_id, array_to_string(list_filter({O.words(_LETTERS_SQL.format(x='text'))},
       lambda x: NOT list_contains(dict.ws, lower(x))), ' ') AS filtered
FROM documents CROSS JOIN dict""")
def j6_h15_english_word_filter(spark, sf_dir):
    """Letters-only text minus the words of a dictionary table (here
    the words of ``benchmark``), order kept."""
    dictionary = textops.word_dictionary(table(spark, sf_dir, "benchmark"), "text")
    return textops.drop_dictionary_words(_docs(spark, sf_dir), "doc_id", "text", dictionary)


def _german_sql(x: str) -> str:
    stop = O.lst(T.GERMAN_STOPWORDS)
    lines = f"string_split({x}, {NL})"
    first = (f"list_filter({lines}, lambda ln: len(list_intersect(string_split_regex(lower(ln), '\\s+'), {stop})) > 0)[1]")
    rm = "replace(replace(replace({v}, '\"', ''), '''', ''), ':', '')"
    return f"CASE WHEN len({lines}) > 1 THEN {rm.format(v=first)} ELSE {rm.format(v=x)} END"


@register("h14_first_german_line", f"SELECT doc_id, {_german_sql('text')} AS german_line FROM documents")
def h14_first_german_line(spark, sf_dir):
    """Multi-line answer -> its first German line (quotes removed);
    single line -> the line itself; no German line -> null. The language
    test is a stop-word predicate (replaceable by any Column predicate)."""
    d = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("lines"))
    first = F.try_element_at(F.filter("lines", T.is_german_line), F.lit(1))
    one = F.element_at(F.col("lines"), 1)
    return d.select("doc_id", F.when(F.size("lines") > 1, T.remove_extra(first))
                    .otherwise(T.remove_extra(one)).alias("german_line"))
