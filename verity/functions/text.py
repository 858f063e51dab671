"""Text-response functions as Column expressions.

Lambdas below reference only their own variables (or plain columns): Spark
re-evaluates any inline expression a lambda references once per element, so
callers stage arrays such as the sentence list as columns first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verity.functions.sqltext import _c, strip, words

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference's for equal results.
# Sentence boundary: blanks after one of . ! ?   (split on (?<=[.!?]) +)
# Sentiment labels, in priority order: positive, negative, neutral;
#   none found -> neutral
# Characters removed from a translation line: " ' :
# Translation clean-up patterns, in order, case-insensitive except the last:
#   La respuesta debe.*?contener | The response should.*?contain |
#   Texto original en inglés.*? | Original English text.*? | Translation: |
#   Traducción: | Übersetzung: | y no se deben modificar los datos del entrada |
#   and don't alter input text | "[^"]*?"  (quoted text, case-sensitive)
# Lines of 5 characters or fewer (after strip) are dropped.
# A translated piece gets "." appended unless it ends with one of
#   .  !  ?  ...  "  '  )  ;  :
# Poem: exactly 5 non-blank lines; keep the first 5 when longer.
# Letters kept by the English-word filter: a-z A-Z ä ö ü Ä Ö Ü ß and blanks.
# Sentiment token count of the response: the three labels joined,
#   "positivenegativeneutral".
# ---------------------------------------------------------------------------
SENTENCE_SPLIT = r"(?<=[.!?]) +"
SENTIMENTS = ("positive", "negative", "neutral")
REMOVE_CHARS = "\"':"
TRANSLATION_NOISE = (
    r"(?diu)La respuesta debe.*?contener",
    r"(?diu)The response should.*?contain",
    r"(?diu)Texto original en inglés.*?",
    r"(?diu)Original English text.*?",
    r"(?diu)Translation:",
    r"(?diu)Traducción:",
    r"(?diu)Übersetzung:",
    r"(?diu)y no se deben modificar los datos del entrada",
    r"(?diu)and don't alter input text",
    r'"[^"]*?"',
)
MIN_LINE_CHARS = 5
SENTENCE_ENDINGS = (".", "!", "?", "...", '"', "'", ")", ";", ":")
POEM_LINES = 5
LETTERS = r"[^a-zA-ZäöüÄÖÜß\s]"
SENTIMENT_RESPONSE = "".join(SENTIMENTS)
# Our own German stop words for the line-language predicate of H14 (the
# reference calls a language-identification model there).
GERMAN_STOPWORDS = ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "ich", "zu", "mit", "von",
                    "den", "dem", "sie", "es", "auf", "für", "im", "sich")


def split_sentences(col) -> Column:
    """Split after ``. ! ?`` on the following blanks; a trailing empty
    piece is kept and empty text gives one empty sentence."""
    return F.split(_c(col), SENTENCE_SPLIT, -1)


def sentiment_label(col) -> Column:
    """The first of positive / negative / neutral (that priority) found
    as a substring of the lower-cased answer; none -> null."""
    low = F.lower(_c(col))
    out = F
    for s in SENTIMENTS:
        out = out.when(low.contains(s), F.lit(s))
    return out


def sentence_labels(sentences_col: str) -> Column:
    """The label of each sentence (a lexical stand-in for a model's answer);
    unlabelled sentences are neutral."""
    return F.transform(F.col(sentences_col), lambda s: F.coalesce(sentiment_label(s), F.lit("neutral")))


def sentiment_counts(sentences_col: str, labels: Column | None = None) -> list[Column]:
    """positive/negative/neutral counts over a staged sentence array.
    ``labels`` defaults to labelling each sentence itself (a lexical stand-in
    for a model's answer); unlabelled sentences count as neutral."""
    lab = labels if labels is not None else sentence_labels(sentences_col)

    def count(v):
        return F.size(F.filter(lab, lambda x: x == v)).cast("bigint").alias(v)

    return [count(v) for v in SENTIMENTS]


def remove_extra(col) -> Column:
    """Drop double quotes, single quotes and colons."""
    return F.translate(_c(col), REMOVE_CHARS, "")


def clean_translation(col) -> Column:
    """Strip code fences and the explanation patterns, drop lines of 5
    characters or fewer, join by blanks, collapse whitespace, strip."""
    t = F.regexp_replace(_c(col), r"(?d)^```.*?\n", "")
    t = F.regexp_replace(t, r"(?d)\n```$", "")
    for pat in TRANSLATION_NOISE:
        t = F.regexp_replace(t, pat, "")
    lines = F.filter(F.split(t, "\n", -1), lambda ln: F.length(strip(ln)) > MIN_LINE_CHARS)
    return strip(F.regexp_replace(F.array_join(lines, " "), r"(?U)\s+", " "))


def reassemble(pieces_col: str) -> Column:
    """Concatenate translated pieces with no separator, appending "."
    to a piece that does not end like a sentence."""
    return reassemble_expr(F.col(pieces_col))


def reassemble_expr(pieces: Column) -> Column:
    """``reassemble`` over an array expression."""
    def one(p):
        ends = F.lit(False)
        for e in SENTENCE_ENDINGS:
            ends = ends | p.endswith(e)
        return F.when(ends, p).otherwise(F.concat(p, F.lit(".")))
    return F.array_join(F.transform(pieces, one), "")


def nonblank_lines(col) -> Column:
    """Lines (split on line feeds) that are not blank."""
    return F.filter(F.split(_c(col), "\n", -1), lambda ln: strip(ln) != "")


def first_lines(lines_col: str, n: int = POEM_LINES) -> Column:
    """T4 / H19 truncate: the first ``n`` non-blank lines, line-feed joined."""
    return F.array_join(F.slice(F.col(lines_col), 1, n), "\n")


def keywords(col) -> Column:
    """Split on commas and lower-case (no trimming)."""
    return F.transform(F.split(_c(col), ",", -1), lambda k: F.lower(k))


def letters_only(col) -> Column:
    """Letters (with German umlauts) and whitespace only."""
    return F.regexp_replace(_c(col), "(?U)" + LETTERS, "")


def is_german_line(line: Column) -> Column:
    """H14 predicate: a line containing one of the German stop words."""
    stop = F.array(*[F.lit(w) for w in GERMAN_STOPWORDS])
    return F.size(F.array_intersect(F.split(F.lower(line), r"(?U)\s+", -1), stop)) > 0


def token_count(col) -> Column:
    """H24 default: whitespace words (a BPE vocabulary is not available
    offline; see ``verity.functions.tokens`` for a pluggable encoder)."""
    return F.size(words(col)).cast("bigint")
