"""Line dedup by a tree of line templates [native].

A line's path through the tree has fixed depth: its number of tokens, then its
first ``DEPTH`` tokens, with variable fields (tokens that hold a digit) as one
mark. In each leaf, a token's support at a place is the number of texts that have
it there, counted for each different line; supports are put into classes by powers
of two from ``MIN_TEXTS`` on. A line's templates leave open the places below some
class, or these and one class above them, as long as at least ``ALIKE`` of its
places stay. As supports are absolute, it does not matter how many other templates
or unrelated lines fill a leaf: a template's constants have at least the support
of its own texts, and some class parts them from its fields.

The template of a line's own tokens (a repeated line or passage) is boilerplate
where at least ``MIN_REPEATS`` different texts have it, one with open places from
``MIN_TEXTS`` on: its lines are dropped from every document. Texts that are equal
but for white space count once, so copies of a document don't make its lines
boilerplate; lines of under ``MIN_TOKENS`` tokens are left alone.

Only built-in expressions run. Statistics are aggregated before they are
shuffled; equal lines are one row before their places are counted, and no list
is longer than a line.

Defined results: a null text has no lines and stays null; an empty text keeps its
one empty line; documents are told apart by identifier and text, so null and
repeated identifiers do no harm and repeated rows come back as often as given; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.shared import written

DEPTH = 3
ALIKE = 0.7
MIN_REPEATS = 2
MIN_TEXTS = 3
MIN_TOKENS = 3
# What follows a token's first digit, and white space that ends no line. Both patterns start
# with one plain class, so that text without them is passed over quickly; \s and \S are SPACE and WORD.
FROM_DIGIT = r"\d\S*+"
INLINE_SPACE = r"[\t\x0B\f\r]"
# A line of MIN_TOKENS tokens or more; nothing is read beyond the first ones.
LONG_ENOUGH = r"\S\s+" + r"\S+\s+" * (MIN_TOKENS - 2) + r"\S"


def marked_texts(docs: DataFrame) -> DataFrame:
    """``mark``, the ``text`` with blanks between tokens and each token that holds a digit
    cut to end in 0 at its first digit, and the hash of the text without white space (``body``)."""
    cut = F.regexp_replace(F.regexp_replace("text", FROM_DIGIT, "0"), INLINE_SPACE, " ")
    return docs.select("mark", cut.alias("text"), F.xxhash64(F.regexp_replace("text", r"\s+", "")).alias("body"))


def line_table(marked: DataFrame) -> DataFrame:
    """One row per line of ``MIN_TOKENS`` tokens or more of ``marked_texts``: its text's mark, the
    hash of its text without white space (``body``), its place, its leaf, the template of its own tokens, and short hashes of the
    tokens, variable fields as one. Short hashes are only held against the few
    constant tokens of one place of one leaf."""
    lines = marked.select("mark", "body", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(LONG_ENOUGH))
    # A token ends in 0 where it held a digit, and a line without any needs no look at its tokens.
    split = lines.select("mark", "body", "at", F.col("line").contains("0").alias("fields"), F.array_remove(F.split("line", " ", -1), "").alias("words"))
    tokens = split.withColumn("words", F.when(F.col("fields"), F.transform("words", lambda w: F.when(w.endswith("0"), "0").otherwise(w))).otherwise(F.col("words")))
    return tokens.select("mark", "body", "at", F.transform("words", lambda w: F.hash(w)).alias("tokens"), F.xxhash64(F.lit("own"), "words").alias("own"),
                         F.xxhash64(F.size("words"), *[F.get("words", F.lit(i)) for i in range(DEPTH)]).alias("leaf"))


def open_templates(kinds: DataFrame) -> DataFrame:
    """``own`` of each different line (one row with ``leaf``, ``tokens``, ``texts`` and
    the least and greatest ``body``) and each ``template`` with open places it has."""
    several = kinds.groupBy("leaf").agg(F.min("own").alias("first"), F.max("own").alias("last"), F.sum("texts").alias("n")).where(
        (F.col("first") != F.col("last")) & (F.col("n") >= MIN_TEXTS)).select("leaf")
    # The first tokens are equal in a whole leaf.
    places = kinds.join(several, "leaf").select("leaf", "own", "texts", F.posexplode(F.expr(f"slice(tokens, {DEPTH + 1}, size(tokens))")).alias("place", "token")).withColumn(
        "key", F.xxhash64("leaf", "place", "token"))
    support = places.groupBy("key").agg(F.sum("texts").alias("n")).where(F.col("n") >= MIN_TEXTS)
    ranked = places.join(support.select("key", F.floor(F.log2(F.col("n") / MIN_TEXTS)).cast("int").alias("rank")), "key", "left")
    # Place, rank + 1 (0 below MIN_TEXTS) and token in one number, which sorts by place.
    packed = F.shiftleft(F.col("place").cast("long"), 38) + F.shiftleft(F.coalesce("rank", F.lit(-1)).cast("long") + 1, 32) + (F.col("token").cast("long") + (1 << 31))
    lines = ranked.groupBy("leaf", "own").agg(F.array_sort(F.collect_list(packed)).alias("at"))

    def rank(x):
        return F.shiftright(x, 32).bitwiseAND(F.lit(63))

    def stays(x, cut):
        return (rank(x) >= cut.low) & (rank(x) != cut.one)

    # A token of fewer texts than a template needs is open in every template.
    found = lines.withColumn("ranks", F.transform("at", rank)).where(F.size(F.filter("ranks", lambda r: r > 0)) + DEPTH >= ALIKE * (F.size("at") + DEPTH)).withColumn(
        "ranks", F.array_distinct("ranks"))
    # Ranks below one are open, and one rank from there on (or none: -1).
    cuts = F.flatten(F.transform(F.array_distinct(F.concat(F.array(F.lit(1).cast("long")), F.transform("ranks", lambda r: r + 1))), lambda low: F.transform(
        F.filter(F.concat(F.array(F.lit(-1).cast("long")), "ranks"), lambda one: (one >= low) | (one == -1)), lambda one: F.struct(low.alias("low"), one.alias("one")))))
    alike = F.filter(cuts, lambda c: (F.size(F.filter("at", lambda x: stays(x, c))) + DEPTH >= ALIKE * (F.size("at") + DEPTH)) & F.exists("at", lambda x: ~stays(x, c)))
    opened = F.transform("cuts", lambda c: F.xxhash64("leaf", F.transform("at", lambda x: F.when(stays(x, c), x.bitwiseAND(F.lit((1 << 32) - 1))).otherwise(F.lit(1 << 40)))))
    made = found.withColumn("cuts", alike).where(F.size("cuts") > 0)
    return made.select("own", F.explode(F.array_distinct(opened)).alias("template"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """``mark`` and ``at`` of each line that goes."""
    leaves = lines.groupBy("leaf").agg(F.min("body").alias("one"), F.max("body").alias("other")).where(F.col("one") != F.col("other")).select("leaf")
    busy = written(lines.join(leaves, "leaf"), "busy-lines")
    # Counted by line and text, so a line that a third of all texts have adds one row a task and text.
    kinds = written(busy.groupBy("leaf", "own").agg(F.count_distinct("body").alias("texts"), F.min("body").alias("one"), F.max("body").alias("other"),
                                                    F.first("tokens").alias("tokens")), "line-kinds")
    made = written(open_templates(kinds), "templates")
    # A line of three texts or more is enough by itself; others have no text but these two.
    texts = made.join(kinds.select("own", "texts", F.array_distinct(F.array("one", "other")).alias("bodies")), "own").select("template", "texts", F.explode("bodies").alias("body"))
    recurring = texts.groupBy("template").agg(F.max("texts").alias("most"), F.count_distinct("body").alias("texts")).where(
        F.greatest("most", "texts") >= MIN_TEXTS).select("template")
    goes = made.join(recurring, "template").select("own").union(kinds.where(F.col("texts") >= MIN_REPEATS).select("own")).distinct()
    return busy.select("mark", "at", "own").join(goes, "own").select("mark", "at")


def drop_boilerplate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_dropped`` and the ``text``
    that is left."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn(
        "mark", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    # Texts are marked before the shuffle that both uses of the lines read; equal ones are split into lines once.
    distinct = marked_texts(rows.where("text is not null")).groupBy("mark").agg(F.first("text").alias("text"), F.first("body").alias("body"))
    dropped = boilerplate(line_table(distinct)).groupBy("mark").agg(F.collect_set("at").alias("dropped"))
    found = rows.join(dropped, "mark", "left").withColumn("lines", F.split("text", "\n", -1)).withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    left = F.filter("lines", lambda x, i: ~F.array_contains("dropped", i))
    return found.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
                        F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))
