"""Quality rules as weak supervision [native].

Ten rules over a whole text vote good (true), bad (false) or abstain (null).
Expectation-maximisation over the counts of vote patterns estimates, for good
and for bad texts, how often each rule votes which way; the posterior
probability of a good text then decides. Nothing asks that all rules pass.

Only patterns and their counts reach the driver: at most 3 to the power of the
number of rules, whatever the number of documents. All features are built-in
expressions on the row; nothing is shuffled but the patterns.

Defined results: a null or empty text has no words and fails the base rules; very
long texts are counted whole and judged by the same rules as short ones; rows with
equal votes, and so ties, get equal verdicts;
every row is judged alone, so null identifiers and repeated rows are as good as
any; an empty table gives an empty table; the columns of ``docs`` pass through
``good_documents`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.llm.shared import SPACE, WORD, text_or_empty, words_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
ROUNDS = 40
FALSE_ALARM = 0.02
# Different words grow with a power of the number of words; prose of any length lies above the first one.
GOOD_VARIETY, BAD_VARIETY = 0.8, 0.7


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, also where it appears in lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a window of three that the text holds twice or
    more. Windows are 64-bit hashes, sorted with their positions, so that equal
    ones are neighbours; texts without equal windows skip the sort."""
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"])))
        at = bind(pairs, lambda s: F.transform(twice(s), lambda x: x["p"]))
        return bind(at, lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)), F.transform(p, lambda i: i + 2))))

    counted = bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(F.size(hashes) > WINDOW, counted).otherwise(0).cast("long")


def with_features(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the struct ``_f`` of counts over the whole text."""
    body = text_or_empty(text)
    without = lambda pattern: F.length(F.regexp_replace(F.col("_text"), pattern, ""))
    staged = rows.withColumn("_text", body).withColumn("_words", words_of(F.col("_text"))).withColumn(
        "_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn(
        "_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": without(SPACE),
        "n_symbols": F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_hashes")),
        "n_lines": F.size("_lines"),
        "n_closed_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?…:;\"'”’)][\x20\x09-\x0D]*$"))),
        "n_kinds": F.size(F.array_distinct("_hashes")),
        "n_upper": without(r"[^\p{Lu}]+"),
        "n_letters": without(r"[^\p{L}]+"),
        "n_bare": F.regexp_count("_text", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")),
        "n_shouts": F.length("_text") - F.length(F.translate("_text", "!?", "")),
    }
    return staged.withColumn("_f", F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])).drop("_text", "_words", "_hashes", "_lines")


def votes(f: Column) -> dict[str, Column]:
    """Each rule's vote on the counts: true where good, false where bad, else null."""
    words, letters, lines = (F.greatest(f[k], F.lit(1)) for k in ("n_words", "n_letters", "n_lines"))
    rule = lambda good, bad: F.when(f["n_words"] == 0, F.lit(None).cast("boolean")).when(bad, False).when(good, True)
    return {
        "symbols": rule(f["n_symbols"] <= 0.02 * words, f["n_symbols"] > 0.1 * words),
        "repeats": rule(f["n_repeat_words"] <= 0.15 * words, f["n_repeat_words"] > 0.4 * words),
        "dup_lines": rule((f["n_lines"] >= 4) & (f["n_dup_lines"] <= 0.1 * lines), (f["n_lines"] >= 4) & (f["n_dup_lines"] > 0.3 * lines)),
        "word_length": rule(f["word_chars"].between(3 * words, 9 * words), ~f["word_chars"].between(2 * words, 14 * words)),
        "upper_case": rule(f["n_upper"] <= 0.15 * letters, f["n_upper"] > 0.4 * letters),
        "closed_lines": rule(f["n_closed_lines"] >= 0.5 * lines, (f["n_lines"] >= 4) & (f["n_closed_lines"] < 0.1 * lines)),
        "variety": rule(f["n_kinds"] >= F.pow(words, F.lit(GOOD_VARIETY)), f["n_kinds"] < F.pow(words, F.lit(BAD_VARIETY))),
        "shouts": rule(f["n_shouts"] <= 0.05 * words, f["n_shouts"] > 0.2 * words),
        "bare_words": rule(f["n_bare"] <= 0.05 * words, f["n_bare"] > 0.2 * words),
        "letters": rule(f["n_letters"] >= 0.85 * f["word_chars"], f["n_letters"] < 0.7 * f["word_chars"]),
    }


def fit(patterns: Iterable[tuple[tuple[bool | None, ...], int]], rounds: int = ROUNDS) -> tuple[list[float], list[list[float]]]:
    """Expectation-maximisation: the share of each class and, by class and
    rule, how often a vote that is cast is a bad one. Class 0 is good texts, in
    which no rule may raise a false alarm more often than ``FALSE_ALARM``; bad
    texts are of as many kinds as there are rules, as one kind of junk trips one
    rule and pleases the rest. Votes are independent within a class, an
    abstention says nothing, and one vote of either sort is added to each count."""
    patterns = sorted(((tuple(p), n) for p, n in patterns), key=lambda x: [str(v) for v in x[0]])
    rules = range(len(patterns[0][0]) if patterns else 0)
    classes = range(len(rules) + 1)
    share = [0.9] + [0.1 / max(len(rules), 1) for _ in rules]
    alarm = [[FALSE_ALARM for _ in rules]] + [[0.9 if j == k else 0.2 for j in rules] for k in rules]
    for _ in range(rounds if patterns else 0):
        belonging = [responsibilities(share, alarm, p) for p, _ in patterns]
        total = sum(n for _, n in patterns) + len(classes)
        share = [(1 + sum(b[k] * n for b, (_, n) in zip(belonging, patterns))) / total for k in classes]
        for k in classes:
            for j in rules:
                cast = [(b[k] * n, p[j]) for b, (p, n) in zip(belonging, patterns) if p[j] is not None]
                bad = (1 + sum(x for x, v in cast if not v)) / (2 + sum(x for x, _ in cast))
                alarm[k][j] = bad if k else min(bad, FALSE_ALARM)
    return share, alarm


def responsibilities(share: list[float], alarm: list[list[float]], pattern: tuple[bool | None, ...]) -> list[float]:
    logs = [math.log(s) + sum(math.log((1 - a) if v else a) for a, v in zip(row, pattern) if v is not None) for s, row in zip(share, alarm)]
    top = max(logs)
    parts = [math.exp(x - top) for x in logs]
    return [x / sum(parts) for x in parts]


def posterior(share: list[float], alarm: list[list[float]], cast: list[Column]) -> Column:
    """The probability of class 0 given the votes, as an expression."""
    likelihoods = []
    for s, row in zip(share, alarm):
        log = F.lit(math.log(s))
        for a, v in zip(row, cast):
            log = log + F.when(v, math.log(1 - a)).when(~v, math.log(a)).otherwise(0.0)
        likelihoods.append(F.exp(log))
    return likelihoods[0] / sum(likelihoods[1:], likelihoods[0])


def judged(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``_f`` (counts), ``_good`` (posterior probability of a
    good text), ``_base_failed`` and ``_kept``. Written once, as the votes'
    statistics and the verdicts both need the counts."""
    counted = written(with_features(rows, text), "counts")
    cast = votes(F.col("_f"))
    patterns = counted.select(*[v.alias(k) for k, v in cast.items()]).groupBy(*cast).count()
    share, alarm = fit((tuple(r[k] for k in cast), r["count"]) for r in patterns.collect())  # at most 3^10 rows
    # The posterior names each vote many times: bound, or the optimizer would write out every vote's
    # rule as often, in code too long to compile.
    good = bind(F.array(*cast.values()), lambda v: posterior(share, alarm, [F.get(v, F.lit(j)) for j in range(len(cast))]))
    f = F.col("_f")
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
    scored = counted.withColumn("_good", good).withColumn("_base_failed", failed)
    return scored.withColumn("_kept", ~F.col("_base_failed") & (F.col("_good") >= KEEP_FROM))


def quality_verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``,
    ``good`` (the posterior) and ``kept``."""
    rows = judged(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col("_f")[k].alias(k) for k in base], F.col("_base_failed").alias("base_failed"),
                       F.col("_kept").alias("kept"), F.col("_good").alias("good"))


def good_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    return judged(rows.withColumn("_body", F.col(f"_all.`{text}`")), "_body").where("_kept").select("_all.*")
