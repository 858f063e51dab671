"""Financial-record extraction from prose (H21-H23, U7) as Column logic.

A text holds user blocks ``NAME earns ₹N ...`` up to ``. X`` or the end; each
block yields salary, expenses, investments, savings, loans and debts. Blocks are
found without a search pattern: a text is split at its block ends, a sentence
at its markers, and the first marker that can open a block takes the rest of
its sentence, so a text is read once however long its letter runs are. Maps
keep the last amount of a repeated item, built without relying on the session's
map-key dedup policy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verity.functions.sqltext import _c, strip, words

# ---------------------------------------------------------------------------
# FIXED VALUES — the reference's extraction patterns (₹ is the rupee sign).
#   block        ([A-Za-z\s]+) earns ₹([\d,]+) .+?(?=\. [A-Za-z]|$)
#   salary       earns ₹([\d,]+)
#   expenses     spends ₹([\d,]+)
#   investments  invested ₹([\d,]+) in ([^,\.]+)
#   savings      savings of ₹([\d,]+) in ([^,\.]+)
#   loans        ([\w\s]+) loan of ₹([\d,]+)
#   debts        ([\w\s]+) debt of ₹([\d,]+)
# Amounts drop "₹" and "," before the integer parse.
# ---------------------------------------------------------------------------
SALARY = r"(?U)earns ₹([\d,]+)"
EXPENSES = r"(?U)spends ₹([\d,]+)"
INVESTED = r"(?dU)invested ₹([\d,]+) in ([^,\.]+)"
SAVINGS = r"(?dU)savings of ₹([\d,]+) in ([^,\.]+)"
# An item begins where a run of words or the rest of one after a match begins, so no run is tried twice.
LOAN = r"(?U)(?:\G|(?<![\w\s]))([\w\s]+) loan of ₹([\d,]+)"
DEBT = r"(?U)(?:\G|(?<![\w\s]))([\w\s]+) debt of ₹([\d,]+)"
RECORD_SCHEMA = (
    "array<struct<name:string,salary:bigint,expenses:bigint,investments:map<string,bigint>,"
    "debts:map<string,bigint>,loans:map<string,bigint>,savings:bigint>>"
)


def amount(col) -> Column:
    """Drop the rupee sign and digit-group commas, parse as an integer
    (unparseable -> null instead of an exception)."""
    return F.translate(_c(col), "₹,", "").try_cast("bigint")


def _last_wins_map(keys: Column, values: Column) -> Column:
    """Keys and values are computed once: a lambda would repeat them for every key."""
    def of(rk, rv, dk):
        return F.map_from_arrays(dk, F.transform(dk, lambda k: F.element_at(rv, F.array_position(rk, k).cast("int"))))

    return _let(F.reverse(keys), lambda rk: _let(F.reverse(values), lambda rv: _let(F.array_distinct(rk), lambda dk: of(rk, rv, dk))))


def _all(block: Column, pattern: str, group: int, word: str) -> Column:
    """All of a group; a block without the pattern's ``word`` is not searched."""
    return F.when(~block.contains(word), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(block, F.lit(pattern), F.lit(group)))


def _items(block: Column, pattern: str, amount_group: int, item_group: int, word: str) -> Column:
    keys = F.transform(_all(block, pattern, item_group, word), lambda k: F.lower(strip(k)))
    vals = F.transform(_all(block, pattern, amount_group, word), lambda a: amount(a))
    return _last_wins_map(keys, vals)


def user_record(block: Column, name: Column) -> Column:
    """One user struct from a block (loans/debts read amount and item from
    their own groups; the reference swaps them and fails on any match)."""
    savings = F.try_element_at(_all(block, SAVINGS, 1, "savings of ₹"), F.lit(-1))
    return F.struct(
        strip(name).alias("name"),
        amount(F.regexp_extract(block, SALARY, 1)).alias("salary"),
        amount(F.regexp_extract(block, EXPENSES, 1)).alias("expenses"),
        _items(block, INVESTED, 1, 2, "invested ₹").alias("investments"),
        _items(block, DEBT, 2, 1, " debt of ₹").alias("debts"),
        _items(block, LOAN, 2, 1, " loan of ₹").alias("loans"),
        F.coalesce(amount(savings), F.lit(0)).cast("bigint").alias("savings"),
    )


MARKER = " earns ₹"  # literal every block contains
_END = r"\.(?= [A-Za-z])"
_NAME_LAST = r"(?U)[A-Za-z\s]\z"
_NAME_REVERSED = r"(?U)^[A-Za-z\s]+"
_AMOUNT_FIRST = r"(?U)^[\d,]+( |\z)"  # a next marker begins with the blank
_AMOUNT_AND_REST = r"(?U)^[\d,]+ ."
_AMOUNT_ALONE = r"(?U)^[\d,]+ \z"
FOUND_TYPE = "array<struct<name:string,block:string>>"


def _first_block(sentence: Column, i: Column) -> Column:
    """The block that a sentence opens, or null: its place, name and text, and
    whether it ends right after its amount (``open``: a block needs one more
    character, so it takes the next sentence too)."""
    def of(parts):
        last = F.size(parts) - 1

        def usable(j):
            after = F.get(parts, j)
            return F.get(parts, j - 1).rlike(_NAME_LAST) & F.when(j < last, after.rlike(_AMOUNT_FIRST)).otherwise(
                after.rlike(_AMOUNT_AND_REST) | after.rlike(_AMOUNT_ALONE))

        def after_break(broken):
            # No line break may follow the marker, so only those after the last one count.
            return F.array_min(F.filter(F.sequence(F.lit(1), last), lambda j: (j > broken) & usable(j)))

        def block(j):
            name = F.reverse(F.regexp_extract(F.reverse(F.get(parts, j - 1)), _NAME_REVERSED, 0))
            return F.when(j.isNotNull(), F.struct(
                i.alias("i"), name.alias("name"),
                F.concat(name, F.lit(MARKER), F.array_join(F.slice(parts, j + 1, last - j + 1), MARKER)).alias("block"),
                ((j == last) & F.get(parts, j).rlike(_AMOUNT_ALONE)).alias("open")))

        breaks = F.array_max(F.transform(parts, lambda p, j: F.when((j > 0) & p.contains("\n"), j).otherwise(0)))
        return _let(_let(breaks, after_break), block)

    return F.when(sentence.contains(MARKER), _let(F.split(sentence, MARKER, -1), of))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (a lambda would repeat it)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _joined(sentences: Column, heads: Column) -> Column:
    """Blocks where some are open: in order, a sentence that an open block took opens none."""
    start = F.struct(F.lit(0).alias("free"), F.array().cast(FOUND_TYPE).alias("found"))

    def step(acc, h):
        following = F.get(sentences, h["i"] + 1)
        closes = following.isNotNull() & ~F.coalesce(following.contains("\n"), F.lit(False))
        text = F.when(h["open"], F.concat(h["block"], F.lit("."), following)).otherwise(h["block"])
        taken = F.struct(F.when(h["open"], h["i"] + 2).otherwise(acc["free"]).alias("free"),
                         F.array_append(acc["found"], F.struct(h["name"].alias("name"), text.alias("block"))).alias("found"))
        return F.when((h["i"] >= acc["free"]) & (~h["open"] | closes), taken).otherwise(acc)

    return F.aggregate(heads, start, step, lambda acc: acc["found"])


def user_blocks(text) -> Column:
    """Name and text of each user block, in order; null for a null text."""
    t = _c(text)
    # The end of a text lies before one last line break.
    whole = F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t)

    def of(sentences):
        heads = F.filter(F.transform(sentences, _first_block), lambda h: h.isNotNull())
        return _let(heads, lambda hs: F.when(F.exists(hs, lambda h: h["open"]), _joined(sentences, hs)).otherwise(
            F.transform(hs, lambda h: F.struct(h["name"].alias("name"), h["block"].alias("block")))))

    return F.when(t.contains(MARKER), _let(F.split(whole, _END, -1), of)).when(t.isNotNull(), F.array().cast(FOUND_TYPE))


def users_from(found_col: str) -> Column:
    """H22 over staged blocks."""
    return F.transform(F.col(found_col), lambda f: user_record(f["block"], f["name"]))


def missing_spends(found_col: str) -> Column:
    """Strict reading: a block without 'spends' fails the whole request."""
    return F.exists(F.col(found_col), lambda f: ~f["block"].rlike(EXPENSES))


def loan_or_debt_present(found_col: str) -> Column:
    """Strict (compat) reading: any loan/debt match fails the request."""
    return F.exists(F.col(found_col), lambda f: f["block"].rlike(LOAN) | f["block"].rlike(DEBT))


def schema_violations(users_col: str) -> Column:
    """H23 for the route's JSON Schema subset: required name/salary/expenses,
    integers and map values >= 0. Returns the list of violations."""
    def user_issues(u, i):
        checks = [
            (u["name"].isNull(), "name is required"),
            (u["salary"].isNull(), "salary is required"),
            (u["expenses"].isNull(), "expenses is required"),
            (u["salary"] < 0, "salary below minimum 0"),
            (u["expenses"] < 0, "expenses below minimum 0"),
            (u["savings"] < 0, "savings below minimum 0"),
        ]
        for m in ("investments", "debts", "loans"):
            checks.append((F.exists(F.map_values(u[m]), lambda v: v.isNull() | (v < 0)), f"{m} value below minimum 0"))
        return F.filter(F.array(*[F.when(c, F.concat(F.lit("users["), i.cast("string"), F.lit(f"]: {msg}")))
                                  for c, msg in checks]), lambda x: x.isNotNull())
    return F.flatten(F.transform(F.col(users_col), user_issues))


def _space_gaps(col: Column) -> Column:
    """Blank runs inside a value (each splits one more token in a repr)."""
    s = F.trim(col)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " +", -1)) - 1)


def output_tokens(date: Column, users_col) -> Column:
    """Whitespace words of the Python ``str()`` of {date, users} without
    building the string: 4 + 13 per user + (users - 1) separators + 2k - 1
    per non-empty map of k items + blanks inside the date, names, map keys."""
    u = _c(users_col)
    n = F.size(u)

    def per_user(x):
        maps = [x["investments"], x["debts"], x["loans"]]
        extra = F.lit(0)
        for m in maps:
            k = F.size(m)
            gaps = F.aggregate(F.map_keys(m), F.lit(0), lambda acc, key: acc + _space_gaps(key))
            extra = extra + F.when(k > 0, 2 * k - 1).otherwise(0) + gaps
        return F.lit(13) + _space_gaps(x["name"]) + extra

    per = F.aggregate(F.transform(u, per_user), F.lit(0), lambda acc, v: acc + v)
    return (F.lit(4) + per + F.greatest(n - 1, F.lit(0)) + _space_gaps(date)).cast("bigint")


def input_tokens(text) -> Column:
    return F.size(words(text)).cast("bigint")
