"""Text-to-SQL scoring as Spark Column expressions.

Every function maps Columns to Columns, so scorers run inside whole-stage
codegen'd projections (higher-order functions run interpreted but JVM-side)
and are usable from SQL through a temp view. No Python UDF is involved.

Regexes are Java regexes prefixed with ``(?U)`` so ``\\s``, ``\\w``, ``\\d``
and ``\\b`` are Unicode-aware, as they are for Python's ``re`` on ``str``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference's for equal scores.
#
# Clause patterns of the flexible component match, in the reference's order,
# matched case-insensitively against the advanced normal form:
#   select_cols   select\s+(.*?)(?:\s+from\b|$)
#   from_tables   from\s+(.*?)(?:\s+where\b|\s+group\b|\s+order\b|\s+limit\b|$)
#   where_clause  where\s+(.*?)(?:\s+group\b|\s+order\b|\s+limit\b|$)
#   group_by      group\s+by\s+(.*?)(?:\s+having\b|\s+order\b|\s+limit\b|$)
#   having        having\s+(.*?)(?:\s+order\b|\s+limit\b|$)
#   order_by      order\s+by\s+(.*?)(?:\s+limit\b|$)
#   limit         limit\s+(\d+)
# Clause weights: select_cols 0.3, from_tables 0.2, where_clause 0.2,
#   group_by 0.1, having 0.1, order_by 0.05, limit 0.05
# Structural patterns (16): \bselect\b, \bfrom\b, \bwhere\b, \bgroup\s+by\b,
#   \bhaving\b, \border\s+by\b, \bjoin\b, \bunion\b, \bintersect\b,
#   \bexcept\b, \bdistinct\b, \bcount\s*\(, \bsum\s*\(, \bavg\s*\(,
#   \bmax\s*\(, \bmin\s*\(
# Basic-component patterns (6, unused by the live score):
#   select_cols   SELECT\s+(.*?)\s+FROM
#   from_tables   FROM\s+(.*?)(?:WHERE|GROUP BY|ORDER BY|LIMIT|$)
#   where_clause  WHERE\s+(.*?)(?:GROUP BY|ORDER BY|LIMIT|$)
#   group_by      GROUP BY\s+(.*?)(?:ORDER BY|LIMIT|HAVING|$)
#   order_by      ORDER BY\s+(.*?)(?:LIMIT|$)
#   limit         LIMIT\s+(\d+)
# Operator spacing of the basic normal form, in order: =, >, <, >=, <=, <>, !=
# Aggregate names squeezed against "(": count, sum, avg, max, min
# Thresholds of the execution proxy: component > 0.85 and structural > 0.7
# Token-efficiency scale: 200 tokens; BLEU: 4-grams, weights 0.25 each;
# a zero n-gram precision counts as the smallest normal double.
# Supported statement kinds (validity check, operation inference):
#   select, insert, update, delete, create, alter
# ---------------------------------------------------------------------------

CLAUSES = (
    ("select_cols", r"select\s+(.*?)(?:\s+from\b|$)", 0.3),
    ("from_tables", r"from\s+(.*?)(?:\s+where\b|\s+group\b|\s+order\b|\s+limit\b|$)", 0.2),
    ("where_clause", r"where\s+(.*?)(?:\s+group\b|\s+order\b|\s+limit\b|$)", 0.2),
    ("group_by", r"group\s+by\s+(.*?)(?:\s+having\b|\s+order\b|\s+limit\b|$)", 0.1),
    ("having", r"having\s+(.*?)(?:\s+order\b|\s+limit\b|$)", 0.1),
    ("order_by", r"order\s+by\s+(.*?)(?:\s+limit\b|$)", 0.05),
    ("limit", r"limit\s+(\d+)", 0.05),
)

STRUCTURES = (
    r"\bselect\b", r"\bfrom\b", r"\bwhere\b", r"\bgroup\s+by\b", r"\bhaving\b",
    r"\border\s+by\b", r"\bjoin\b", r"\bunion\b", r"\bintersect\b", r"\bexcept\b",
    r"\bdistinct\b", r"\bcount\s*\(", r"\bsum\s*\(", r"\bavg\s*\(", r"\bmax\s*\(",
    r"\bmin\s*\(",
)

BASIC_CLAUSES = (
    ("select_cols", r"SELECT\s+(.*?)\s+FROM"),
    ("from_tables", r"FROM\s+(.*?)(?:WHERE|GROUP BY|ORDER BY|LIMIT|$)"),
    ("where_clause", r"WHERE\s+(.*?)(?:GROUP BY|ORDER BY|LIMIT|$)"),
    ("group_by", r"GROUP BY\s+(.*?)(?:ORDER BY|LIMIT|HAVING|$)"),
    ("order_by", r"ORDER BY\s+(.*?)(?:LIMIT|$)"),
    ("limit", r"LIMIT\s+(\d+)"),
)

OPERATORS = ("=", ">", "<", ">=", "<=", "<>", "!=")
AGGREGATES = ("count", "sum", "avg", "max", "min")
SQL_OPERATIONS = ("select", "insert", "update", "delete", "create", "alter")
EXEC_COMPONENT_MIN = 0.85
EXEC_STRUCTURAL_MIN = 0.7
TOKEN_SCALE = 200.0
BLEU_MAX_N = 4
FLOAT_MIN = 2.2250738585072014e-308

U = "(?U)"
# The characters of ``(?U)\\s``, for ``trim``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Runs of white space that are not one plain blank.
_RUNS = U + r" \s+|[\s&&[^ ]]\s*"
_ASCII_RUNS = r" [\t\n\x0b\f\r ]+|[\t\n\x0b\f\r][\t\n\x0b\f\r ]*"  # the same in ASCII text


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def apart(col) -> Column:
    """The same column through a higher-order function. A projection that has one is not
    fused with its neighbours, and its columns get methods of their own: fused, the scoring
    makes one method of more than 8,000 bytes, which the JVM leaves uncompiled
    (unless ``spark.sql.codegen.hugeMethodLimit`` says otherwise)."""
    return F.transform(F.array(_c(col)), lambda x: x)[0]


def strip(col) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace."""
    return F.trim(_c(col), F.lit(WHITE))


def single_spaced(col) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(_c(col), _RUNS, " ")


def _is_ascii(col) -> Column:
    """Whether ``(?U)`` makes no difference to a pattern on this text."""
    return F.octet_length(_c(col)) == F.char_length(_c(col))


def words(col) -> Column:
    """Python ``str.split()``: whitespace tokens, empties dropped."""
    return F.filter(F.split(_c(col), U + r"\s+"), lambda t: t != "")


def word_count(col) -> Column:
    """Whitespace word count (the default token counter)."""
    return F.size(words(col)).cast("bigint")


def plain_form(col) -> Column:
    """What both normal forms begin with: lower case, runs of white space as one blank, trimmed."""
    c = _c(col)
    low = F.lower(c)
    ascii_form = F.trim(F.regexp_replace(low, _ASCII_RUNS, " "))  # only blanks are left at its ends
    return F.when(_is_ascii(c), ascii_form).otherwise(strip(single_spaced(low)))


# --- H1 ---------------------------------------------------------------------
def normalize_basic(col) -> Column:
    """H1: lower, collapse whitespace, trim, drop one trailing ``;``, space
    ``=``, ``>``, ``<`` in that order.

    The reference also spaces ``>=``, ``<=``, ``<>`` and ``!=`` afterwards, but
    those rules can never match: once the first three ran, every ``>`` and
    ``<`` is followed by a blank and every ``=`` preceded by one (so
    ``a>=5`` -> ``a > = 5``). They are omitted as provable no-ops."""
    return basic_of(plain_form(col))


def basic_of(plain) -> Column:
    """H1 of a ``plain_form``."""
    q = F.regexp_replace(_c(plain), ";$", "")
    for op in OPERATORS[:3]:  # = < > are literals in Java regex; only blanks are left of white space
        q = F.regexp_replace(q, f" *{op} *", f" {op} ")
    return q


def single_spaced_words(col) -> Column:
    """Tokens of a stripped, single-blank-separated string (normal forms,
    clause texts): a plain split, no per-element lambda."""
    c = _c(col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " ", -1))


# --- H6 ---------------------------------------------------------------------
def normalize_advanced(col) -> Column:
    """H6: empty/null -> ''; lower + strip; collapse whitespace; drop one
    trailing ``;``; unquote backticks and double quotes; ``inner join`` ->
    ``join``; squeeze multi-word keywords; drop ``as`` between two words;
    ``fn (`` -> ``fn(`` for the five aggregates. No final trim."""
    return advanced_of(plain_form(col))


# The steps of H6 after ``plain_form``, each with texts one of which occurs wherever the
# step changes anything (none: not known). Only blanks are left of white space. A pattern
# begins with what is rare and looks back from there; words one blank apart are squeezed already.
# The steps are few: a filter on a form is pushed below them with a copy for each naming.
ADVANCED_STEPS = (
    ((), ((";$", ""),)),
    (("`", '"'), (("`([^`]*)`", "$1"), ('"([^"]*)"', "$1"))),
    (("inner", "  ", " as ", " ("), (
        (U + r"inner(?<=\binner) +join\b", "join"),
        (U + r" (?<=\b(?:left|right|full) ) +join\b", " join"),
        (U + r" (?<=\b(?:group|order) ) +by\b", " by"),
        # A word that the alias before has taken is not taken again.
        (U + r"(?!\G) (?<=\w ) *as +(\w+)", " $1"),
        (U + r" (?<=\b(?:count|sum|avg|max|min) ) *\(", "("))),
)


def advanced_of(plain) -> Column:
    """H6 of a ``plain_form`` ('' for null)."""
    q = _c(plain)
    for _, rules in ADVANCED_STEPS:
        q = _replaced(q, rules)
    return F.coalesce(q, F.lit(""))


def _replaced(q: Column, rules) -> Column:
    for pattern, to in rules:
        q = F.regexp_replace(q, pattern, to)
    return q


def advanced_step(q, step) -> Column:
    """One of ``ADVANCED_STEPS``, taken only where it may change the text. Pass a column:
    it is named several times."""
    c, (marks, rules) = _c(q), step
    if not marks:
        return _replaced(c, rules)
    may = c.contains(marks[0])
    for m in marks[1:]:
        may = may | c.contains(m)
    return F.when(may, _replaced(c, rules)).otherwise(c)


# --- H2 / H3 ------------------------------------------------------------------
def exact_match_basic(gen, ref) -> Column:
    """H2: equality of the basic normal forms, as 1.0 / 0.0."""
    return (normalize_basic(gen) == normalize_basic(ref)).cast("double")


def component_match_basic(gen_norm, ref_norm) -> Column:
    """H3 on basic normal forms: share of clauses present in the reference
    whose text equals the generated one; none present -> 0."""
    matches, total = F.lit(0), F.lit(0)
    for _, pat in BASIC_CLAUSES:
        g = strip(F.regexp_extract(_c(gen_norm), "(?iU)" + pat, 1))
        r = strip(F.regexp_extract(_c(ref_norm), "(?iU)" + pat, 1))
        present = r != ""
        total = total + present.cast("int")
        matches = matches + (present & (g == r)).cast("int")
    return F.when(total > 0, matches / total).otherwise(F.lit(0.0))


# --- H4 ---------------------------------------------------------------------
def token_efficiency(token_count) -> Column:
    """H4: ``1 - min(1, tokens / 200)``."""
    return F.lit(1.0) - F.least(F.lit(1.0), _c(token_count) / F.lit(TOKEN_SCALE))


# --- H7 ---------------------------------------------------------------------
def _factored(pattern: str) -> str:
    """A clause pattern whose ends ``\\s+word`` share their white space, tried once a place."""
    head, _, ends = pattern.partition("(?:")
    words = [e.removeprefix(r"\s+") for e in ends.removesuffix("|$)").split("|")]
    return f"{head}(?:\\s+(?:{'|'.join(words)})|$)" if ends else pattern


def clause_text(norm, pattern: str) -> Column:
    """A clause of an advanced normal form, which is in lower case; '' where there is none.
    A pattern is tried where its first word occurs."""
    c = _c(norm)
    plain = F.when(c.contains(pattern.split("\\")[0]), F.trim(F.regexp_extract(c, _factored(pattern), 1))).otherwise(F.lit(""))
    return F.when(_is_ascii(c), plain).otherwise(strip(F.regexp_extract(c, "(?iU)" + pattern, 1)))


def clause_words(clause) -> Column:
    """The distinct words of a clause text. Clause texts are stripped slices of the
    single-spaced normal form, so a plain split on blanks gives Python's ``split()`` tokens."""
    return F.array_distinct(single_spaced_words(clause))


def clause_columns(clause) -> Column:
    """The distinct comma-separated items of a clause text."""
    return F.array_distinct(F.split(_c(clause), ", *"))


def clause_score(name: str, g: Column, r: Column, r_words: Column | None = None, r_columns: Column | None = None) -> Column:
    """Overlap of one clause with the reference clause (reference present). Equal texts
    share all, without a split. ``r_words``, ``r_columns``: ``clause_words`` and
    ``clause_columns`` of ``r``, where these are at hand."""
    words_r = clause_words(r) if r_words is None else r_words
    same = F.when(g == r, F.lit(1.0))
    # array_intersect drops what its first array repeats.
    tok = F.size(F.array_intersect(single_spaced_words(g), words_r)) / F.size(words_r)
    if name != "select_cols":
        return same.otherwise(tok)
    columns_r = clause_columns(r) if r_columns is None else r_columns
    col_score = F.size(F.array_intersect(F.split(g, ", *"), columns_r)) / F.size(columns_r)
    return same.when(F.concat(g, r).contains("*"), tok).otherwise(col_score)


def clause_scores(gen_norm, ref_norm) -> Column:
    """Per-clause detail: ``array<struct<clause, present, score, weight>>``
    (score is null when the clause is absent from the reference)."""
    items = []
    for name, pat, weight in CLAUSES:
        g, r = clause_text(gen_norm, pat), clause_text(ref_norm, pat)
        present = r != ""
        items.append(
            F.struct(
                F.lit(name).alias("clause"),
                present.alias("present"),
                F.when(present, clause_score(name, g, r)).alias("score"),
                F.lit(weight).alias("weight"),
            )
        )
    return F.array(*items)


def weighted_clauses(scores) -> Column:
    """Weighted mean of (score, weight) pairs whose score is not null, summed
    in the given order; no score -> 0."""
    weighted, total = F.lit(0.0), F.lit(0.0)
    for score, w in scores:
        weighted = weighted + F.coalesce(score * F.lit(w), F.lit(0.0))
        total = total + F.when(score.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(total > 0, weighted / total).otherwise(F.lit(0.0))


def component_match(gen_norm, ref_norm) -> Column:
    """H7: weighted clause overlap renormalised over clauses present in the
    reference; no clause present -> 0. Sums run in the fixed clause order."""
    scores = []
    for name, pat, weight in CLAUSES:
        g, r = clause_text(gen_norm, pat), clause_text(ref_norm, pat)
        scores.append((F.when(r != "", clause_score(name, g, r)), weight))
    return weighted_clauses(scores)


# --- H8 ---------------------------------------------------------------------
def structural_similarity(gen_norm, ref_norm) -> Column:
    """H8: share of the 16 structural flags on which both forms agree."""
    return structure_agreement(structure_flags(gen_norm), structure_flags(ref_norm))


def structure_flags(norm) -> Column:
    """The 16 structural flags of a form as the bits of one number. A pattern is tried
    where its word occurs, but not as it mostly does: between blanks, or after one and before ``(``."""
    c, flags = _c(norm), F.lit(0)
    for i, pat in enumerate(STRUCTURES):
        usual = pat[2:].replace(r"\s*\(", "(").replace(r"\s+", " ").replace(r"\b", " ")
        has = c.contains(pat[2:].split("\\")[0]) & (
            c.startswith(usual) | c.contains(" " + usual) | F.when(_is_ascii(c), c.rlike(pat)).otherwise(c.rlike(U + pat)))
        flags = flags + F.when(has, F.lit(1 << i)).otherwise(F.when(c.isNotNull(), F.lit(0)))
    return flags


def structure_agreement(gen_flags, ref_flags) -> Column:
    differ = F.bit_count(_c(gen_flags).bitwiseXOR(_c(ref_flags)))
    return (F.lit(len(STRUCTURES)) - differ) / F.lit(float(len(STRUCTURES)))


# --- X1 / X2 ----------------------------------------------------------------
def token_overlap(gen_norm, ref_norm) -> Column:
    """Distinct tokens after ``(),`` -> blank; ``|g & r| / max(|r|, 1)``."""
    g = F.array_distinct(words(F.regexp_replace(_c(gen_norm), r"[(),]", " ")))
    r = F.array_distinct(words(F.regexp_replace(_c(ref_norm), r"[(),]", " ")))
    return F.size(F.array_intersect(g, r)) / F.greatest(F.size(r), F.lit(1))


def jaccard(gen_tokens, ref_tokens) -> Column:
    """``|g & r| / |g | r|`` over distinct tokens, 0 if both empty."""
    g, r = F.array_distinct(_c(gen_tokens)), F.array_distinct(_c(ref_tokens))
    union = F.size(F.array_union(g, r))
    return F.when(union > 0, F.size(F.array_intersect(g, r)) / union).otherwise(F.lit(0.0))


# --- H5 ---------------------------------------------------------------------
def word_numbers(tokens) -> Column:
    """The tokens as 64-bit hashes (two of d distinct ones collide with a chance
    of d^2 / 2^65): n-grams are built, sorted and matched as numbers."""
    return F.transform(_c(tokens), lambda w: F.xxhash64(w))


def longer_ngrams(shorter, numbers, n: int) -> Column:
    """The n-grams as numbers from the (n-1)-grams and the words' numbers: each
    (n-1)-gram with the word after it (none when too short). Pass columns."""
    shorter, numbers = _c(shorter), _c(numbers)
    count = F.greatest(F.size(numbers) - n + 1, F.lit(0))
    return F.zip_with(F.slice(shorter, 1, count), F.slice(numbers, n, count), lambda x, w: F.xxhash64(x, w))


def occurrences(sorted_arr) -> Column:
    """Each element of a SORTED array as a number of itself and its occurrence among
    equal elements (``a, a, b`` -> ``(a,1), (a,2), (b,1)``), turning a
    multiset into a set that ``array_intersect`` keeps in a hash set of numbers (struct
    elements would be compared pair by pair). Pass a column (not an inline expression): a
    lambda re-evaluates any expression it references once per element."""
    srt = _c(sorted_arr)
    tagged = F.transform(srt, lambda x, i: F.xxhash64(x, i - F.array_position(srt, x)))
    # Most queries repeat no n-gram: then the elements are their own tags.
    return F.when(F.size(F.array_distinct(srt)) == F.size(srt), F.transform(srt, lambda x: F.xxhash64(x, F.lit(-1).cast("long")))).otherwise(tagged)


def sorted_if_repeating(arr) -> Column:
    """The sorted array where it repeats an element, else null. Pass a column."""
    a = _c(arr)
    return F.when(F.size(F.array_distinct(a)) < F.size(a), F.sort_array(a))


def clipped_matches(cand, ref, cand_sorted, ref_sorted) -> Column:
    """Sum over distinct candidate n-grams of min(count in cand, count in ref): where
    either side repeats none (``sorted_if_repeating`` is null), what both have. Pass columns."""
    c, r = _c(cand_sorted), _c(ref_sorted)
    return F.when(c.isNotNull() & r.isNotNull(), clipped_matches_sorted(c, r)).otherwise(F.size(F.array_intersect(_c(cand), _c(ref))))


def clipped_matches_sorted(cand_sorted, ref_sorted) -> Column:
    """Sum over distinct candidate n-grams of min(count in cand, count in ref)
    from sorted n-gram arrays: the size of the intersection of the
    occurrence-tagged sets (hash-set ``array_intersect``)."""
    return F.size(F.array_intersect(occurrences(cand_sorted), occurrences(ref_sorted)))


def bleu_from_counts(matches, cand_counts, g_len, r_len) -> Column:
    """BLEU from clipped match counts and candidate n-gram counts (n = 1..4)
    plus the candidate and reference lengths."""
    log_sum = F.lit(0.0)
    for m, k in zip(matches, cand_counts):
        p = F.when(m > 0, m / F.greatest(k, F.lit(1))).otherwise(F.lit(FLOAT_MIN))
        log_sum = log_sum + F.lit(1.0 / BLEU_MAX_N) * F.log(p)
    c, rl = _c(g_len), _c(r_len)
    bp = F.when(c > rl, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(F.lit(1.0) - rl / c))
    return F.when(matches[0] == 0, F.lit(0.0)).otherwise(bp * F.exp(log_sum))


def bleu(gen_tokens, ref_tokens) -> Column:
    """H5: sentence BLEU against one reference, n = 1..4, uniform weights, no
    smoothing (Papineni et al. 2002): clipped n-gram precisions, a zero
    precision counted as the smallest normal double, brevity penalty
    ``exp(1 - r/c)`` when ``c <= r``; no unigram match -> 0.

    Self-contained Column form for SQL use; ``verity.operators.sqlbench``
    stages the n-gram arrays as columns so each is built once per row."""
    g, r = word_numbers(gen_tokens), word_numbers(ref_tokens)
    cand, ref = [g], [r]
    for n in range(2, BLEU_MAX_N + 1):
        cand.append(longer_ngrams(cand[-1], g, n))
        ref.append(longer_ngrams(ref[-1], r, n))
    return bleu_from_counts([clipped_matches_sorted(F.sort_array(a), F.sort_array(b)) for a, b in zip(cand, ref)], [F.size(a) for a in cand],
                            F.size(g), F.size(r))


def semantic_similarity(gen, ref, method: str = "bleu") -> Column:
    """H5 / X2 on the basic normal form's whitespace tokens."""
    g, r = single_spaced_words(normalize_basic(gen)), single_spaced_words(normalize_basic(ref))
    if method == "bleu":
        return bleu(g, r)
    if method == "jaccard":
        return jaccard(g, r)
    raise ValueError("method must be 'bleu' or 'jaccard'")


# --- P9 / H10 / H11 -----------------------------------------------------------
def infer_operation(query) -> Column:
    """Statement kind from the leading keyword; default ``select``."""
    q = F.upper(strip(_c(query)))
    out = F
    for op in SQL_OPERATIONS:
        out = out.when(q.startswith(op.upper()), F.lit(op))
    return out.otherwise(F.lit("select"))


def is_valid_sql(query) -> Column:
    """Ends with ``;`` (after strip); mentions a statement keyword
    anywhere; has ``(`` if it says CREATE TABLE; has WHERE if UPDATE or DELETE
    occurs anywhere (substring tests, as written)."""
    q = _c(query)
    up = F.upper(q)
    mentions = F.lit(False)
    for op in SQL_OPERATIONS:
        mentions = mentions | up.contains(op.upper())
    create_ok = ~up.contains("CREATE TABLE") | q.contains("(")
    where_ok = ~(up.contains("UPDATE") | up.contains("DELETE")) | up.contains("WHERE")
    return strip(q).endswith(";") & mentions & create_ok & where_ok


def clean_sql(query) -> Column:
    """Drop a leading sql or bare code fence and a trailing fence, turn
    line feeds into blanks, strip."""
    q = F.regexp_replace(_c(query), r"^```sql\n", "")
    q = F.regexp_replace(q, r"^```\n", "")
    q = F.regexp_replace(q, r"(?d)\n```$", "")
    q = F.regexp_replace(q, "\n", " ")
    return strip(q)
