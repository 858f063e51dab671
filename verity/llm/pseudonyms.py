"""Format-preserving pseudonyms for personal numbers, addresses and dates.

Each value that validates is put through a keyed Feistel permutation of its own
format's values: card numbers (13 to 19 digits with a valid check digit) and IBANs
give others with valid check digits; telephone numbers, social security numbers,
IPv4 addresses and calendar dates (also before a time) give others of their kind,
written alike; the local part of e-mail addresses and quoted hexadecimal secrets
are permuted letter for letter, digit for digit. Digits that stand next to a number
(an expiry date, a security code) do not hide it: numbers may end, and the search
goes on, at each group of digits. A
permutation has no collisions, and the same key gives equal values the same
pseudonym in every document, so links between documents remain, also between notations
of a date and between addresses that differ in case. No value maps to
itself: a permutation moves each number one place along a keyed cycle of them all.

The key must be kept from readers of the result; with it the permutations can be
undone (``Permutation.invert``).

Defined results: null texts stay null, empty ones empty; texts without such values
come back unchanged; rows are independent, so null or repeated identifiers do no
harm; very long texts are searched whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.shared import few_rows

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# Tried in this order where several start at one place.
_KINDS = {kind: re.compile(pattern) for kind, pattern in (
    ("email", r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}"),
    ("secret", r"(?<=[\"'])[0-9a-f]{32,}(?=[\"'])|(?<=[\"'])[0-9A-F]{32,}(?=[\"'])"),
    ("iban", r"(?<![^\W_])[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}"),
    ("phone", r"(?<![\w.])(?:\+|00(?=[1-9]\d{0,2}[ .(-]))\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
              r"|(?<![\w.+-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![\w-]|\.\d)"),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{2}\.\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})"
             r"(?:(?=[Tt_]\d{2})|(?![\w/-]|\.\d))"),
    ("ssn", r"(?<![\w.+-])\d{3}(?:-\d{2}-| \d{2} )\d{4}(?![\w-]|\.\d)"),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"),
    ("card", r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)"))}
_ORDER = list(_KINDS)
_FIND = re.compile("|".join(f"(?P<{kind}>{found.pattern})" for kind, found in _KINDS.items()))
# FIXED VALUES: lengths of card numbers by their first digits, and of IBANs by country.
_CARDS = tuple((re.compile(p), n) for p, n in (
    ("4", (16, 19, 13)), ("3[47]", (15,)), ("3(?:0[0-5]|[689])", (14, 16, 19)), ("35", (16, 19)), ("5[1-5]", (16,)),
    ("2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)", (16,)), ("6", (16, 19, 18, 17)), ("5[06-8]", (16, 19, 18, 17, 15, 14, 13))))
_IBANS = {c: n for n, some in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in some.split()}
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
# FIXED VALUES: telephone country codes of one and two digits; all others have three.
_COUNTRIES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
_MAYBE = re.compile(r"[0-9@]")


class Permutation:
    """A keyed permutation without fixed points of the numbers below ``size`` (two or
    more). An unbalanced Feistel network on two digits in mixed radix, where numbers
    at or above ``size`` are walked on, gives each number its place on a cycle; the
    image is the number at the next place."""

    def __init__(self, key: bytes, size: int, label: str) -> None:
        self.size = size
        self.left = max(2, int(size**0.5))
        self.right = -(-size // self.left)
        self.key = hashlib.blake2b(f"{label}:{size}".encode(), key=key if len(key) <= 64 else hashlib.blake2b(key).digest(), digest_size=32).digest()

    def _round(self, i: int, half: int, modulus: int) -> int:
        return int.from_bytes(hashlib.blake2b(i.to_bytes(1, "big") + half.to_bytes(16, "big"), key=self.key, digest_size=16).digest(), "big") % modulus

    def _once(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for i in range(0, ROUNDS, 2):
            a = (a + self._round(i, b, self.left)) % self.left
            b = (b + self._round(i + 1, a, self.right)) % self.right
        return a * self.right + b

    def _back(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for i in range(ROUNDS - 2, -1, -2):
            b = (b - self._round(i + 1, a, self.right)) % self.right
            a = (a - self._round(i, b, self.left)) % self.left
        return a * self.right + b

    def _place(self, x: int) -> int:
        y = self._once(x)
        while y >= self.size:
            y = self._once(y)
        return y

    def _at(self, y: int) -> int:
        x = self._back(y)
        while x >= self.size:
            x = self._back(x)
        return x

    def __call__(self, x: int) -> int:
        return self._at((self._place(x) + 1) % self.size)

    def invert(self, y: int) -> int:
        return self._at((self._place(y) - 1) % self.size)


def check_digit(digits: str) -> str:
    """The digit that makes the number pass the Luhn test."""
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    """The check digits of an IBAN of this country and account."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _card_at(text: str, start: int, issued: bool = False) -> tuple[int, bool] | None:
    """Characters of the card number that starts here and ends with a group of
    digits, and whether an issuer's numbers look so; those come first."""
    run = _KINDS["card"].match(text, start)
    if run is None:
        return None
    ends, digits = {}, ""
    for g in re.finditer(r"\d+", run.group()):
        digits += g.group()
        ends[len(digits)] = g.end()
    first = next((n for p, n in _CARDS if p.match(digits)), ())
    for n in first if issued else (*first, *(n for n in range(19, 12, -1) if n not in first)):
        if n in ends and check_digit(digits[: n - 1]) == str(int(digits[n - 1])) and len(set(digits[:n])) > 1:
            return ends[n], n in first
    return None


class Pseudonyms:
    def __init__(self, key: bytes) -> None:
        self.key = key
        self.permutations: dict[tuple[int, str], Permutation] = {}

    def permuted(self, x: int, size: int, label: str) -> int:
        found = self.permutations.get((size, label))
        if found is None:
            found = self.permutations[size, label] = Permutation(self.key, size, label)
        return found(x)

    def _digits(self, value: str, label: str) -> str:
        """The value's digits permuted, all else in place."""
        digits = re.sub(r"\D", "", value)
        new = iter(f"{self.permuted(int(digits), 10 ** len(digits), label):0{len(digits)}d}")
        return re.sub(r"\d", lambda _: next(new), value)

    def _letters(self, value: str, alphabet: str, label: str) -> str:
        x = 0
        for c in value:
            x = x * len(alphabet) + alphabet.index(c)
        y, out = self.permuted(x, len(alphabet) ** len(value), label), []
        for _ in value:
            y, digit = divmod(y, len(alphabet))
            out.append(alphabet[digit])
        return "".join(reversed(out))

    def _mixed(self, value: str, label: str) -> str:
        """Small letters, capitals and digits permuted together, each kind in its places."""
        kinds = [next(k for k in _ALPHABETS if c in k) for c in value]
        x = 0
        for c, kind in zip(value, kinds):
            x = x * len(kind) + kind.index(c)
        y, out = self.permuted(x, math.prod(map(len, kinds)), f"{label} {''.join(kind[0] for kind in kinds)}"), []
        for kind in reversed(kinds):
            y, digit = divmod(y, len(kind))
            out.append(kind[digit])
        return "".join(reversed(out))

    # Each kind: the pseudonym and how many characters of the match it stands for.
    def card(self, m: re.Match) -> tuple[str, int] | None:
        found = _card_at(m.string, m.start())
        if found is None:
            return None
        n, issued = found
        value = m.string[m.start(): m.start() + n]
        # Digits in front must not take a number's own.
        if not issued and any(_card_at(m.string, m.start() + g.start(), True) for g in re.finditer(r"(?<=[ -])\d", value)):
            return None
        digits = re.sub(r"\D", "", value)
        body = f"{self.permuted(int(digits[:-1]), 10 ** (len(digits) - 1), 'card'):0{len(digits) - 1}d}"
        new = iter(body + check_digit(body))
        return re.sub(r"\d", lambda _: next(new), value), n

    def iban(self, m: re.Match) -> tuple[str, int] | None:
        value = m.group()
        country = value[:2].upper()
        places = [i for i, c in enumerate(value) if c not in " -"]
        n = _IBANS.get(country, len(places) + 1)
        if n > len(places):
            return None
        end = places[n - 1] + 1
        code = "".join(value[i] for i in places[:n]).upper()
        if m.string[m.start() + end: m.start() + end + 1].isalnum() or code[2:4] != iban_check(country, code[4:]):
            return None
        body = self._mixed(code[4:], "iban " + country)
        new = iter(country + iban_check(country, body) + body)
        return re.sub("[A-Za-z0-9]", lambda c: next(new).lower() if c.group().islower() else next(new), value[:end]), end

    def phone(self, m: re.Match) -> tuple[str, int] | None:
        value = m.group()
        if not value.startswith(("+", "00")):
            return self._digits(value, "phone"), len(value)
        mark = 1 if value[0] == "+" else 2
        code = _COUNTRIES.match(re.sub(r"\D", "", value[mark:])).group()
        # The code's own digits, with what is written between them.
        country = re.match(r"\D*\d" * len(code), value[mark:]).group()
        sizes = {g.end(): len(re.sub(r"\D", "", value[mark: g.end()].replace("(0)", ""))) for g in re.finditer(r"\d+", value)}
        # North American numbers have eleven digits; of others the longest that can be one.
        fit = [e for e, n in sizes.items() if n == 11 and code == "1"] or [e for e, n in sizes.items() if 7 <= n <= 15]
        if not fit:
            return None
        rest = value[mark + len(country): fit[-1]]
        trunk = re.match(r"(?:[ .-]?\(0\))?", rest).group()
        return value[:mark] + country + trunk + self._digits(rest[len(trunk):], "phone"), fit[-1]

    def ssn(self, m: re.Match) -> tuple[str, int] | None:
        value = m.group()
        area, group, serial = map(int, re.split("[ -]", value))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        x = self.permuted(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}{value[3]}{group + 1:02d}{value[3]}{serial + 1:04d}", len(value)

    def ip(self, m: re.Match) -> tuple[str, int] | None:
        parts = m.group().split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big"))), len(m.group())

    def date(self, m: re.Match) -> tuple[str, int] | None:
        value = m.group()
        mark = re.search(r"[-/.]", value).group()
        one, two, three = map(int, value.split(mark))
        # Year first; else day, month, year, or month, day, year where only that is a date.
        year_first = value[:4].isdigit()
        for order in ((one, two, three),) if year_first else ((three, two, one), (three, one, two)):
            try:
                day = datetime.date(*order).toordinal()
            except ValueError:
                continue
            if FIRST_DAY <= day <= LAST_DAY:
                d = datetime.date.fromordinal(FIRST_DAY + self.permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
                if year_first:
                    wide = 2 if value[5] == "0" or len(value) == 10 else 1
                    return f"{d.year}{mark}{d.month:0{wide}d}{mark}{d.day:0{wide}d}", len(value)
                first, second = (d.day, d.month) if order == (three, two, one) else (d.month, d.day)
                wide = 2 if value[0] == "0" or len(value) == 10 else 1
                return f"{first:0{wide}d}{mark}{second:0{wide}d}{mark}{d.year}", len(value)
        return None

    def email(self, m: re.Match) -> tuple[str, int] | None:
        local, domain = m.group().rsplit("@", 1)
        held = "".join(re.findall("[A-Za-z0-9]", local))
        if not held:
            return None
        # Addresses that differ in case alone are one, each written in its own case.
        new = iter(self._mixed(held.lower(), f"email {domain.lower()} {re.sub('[A-Za-z0-9]', '_', local).lower()}"))
        return f"{re.sub('[A-Za-z0-9]', lambda c: next(new).upper() if c.group().isupper() else next(new), local)}@{domain}", len(m.group())

    def secret(self, m: re.Match) -> tuple[str, int]:
        value = m.group()
        return self._letters(value, "0123456789ABCDEF" if re.search("[A-F]", value) else "0123456789abcdef", "secret"), len(value)

    def replaced(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in it."""
        if not _MAYBE.search(text):
            return text, []
        out, spans, at, size, start = [], [], 0, 0, 0
        while m := _FIND.search(text, start):
            for kind in _ORDER[_ORDER.index(m.lastgroup):]:
                hit = m if kind == m.lastgroup else _KINDS[kind].match(text, m.start())
                done = hit and getattr(self, kind)(hit)
                if done:
                    break
            else:
                start = m.start() + 1
                continue
            new, used = done
            out += (text[at: m.start()], new)
            size += m.start() - at
            spans.append((kind, size, size + len(new)))
            size += len(new)
            at = start = m.start() + used
        return "".join([*out, text[at:]]), spans


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, the new ``text``, ``n_replaced`` and the
    ``spans`` replaced (kind, start and end in the new text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in few_rows(batches):
            done = [(None, []) if t is None else names.replaced(t) for t in batch.column("text").to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()),
                                              pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, spans_type)],
                                             names=["doc_id", "text", "n_replaced", "spans"])

    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, text string, n_replaced long, spans array<struct<kind string, start int, end int>>")
