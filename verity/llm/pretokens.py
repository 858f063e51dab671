"""Pre-tokens of whole texts, many texts at a time, as NumPy arrays.

A byte-pair tokenizer works on pre-tokens, so what it makes of a text follows
from what it makes of each distinct pre-token. ``PreTokens.split`` finds them:

- characters below U+0130 in bulk: lower case, then runs of letters, runs of
  marks, single digits, and contractions after an apostrophe, each with a
  64-bit hash taken from running sums (no Python loop over words);
- a text with any other character by the tokenizer's own normaliser and
  splitter, so that the result is the library's in every case.

Long texts are cut at white space, which no pre-token contains, so memory
follows the block and not the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18  # characters handled at once
_ODD = re.compile("[İ-\U0010ffff]")
_GAP, _LETTER, _DIGIT, _MARK = 0, 1, 2, 3


def _classes() -> np.ndarray:
    kind = np.full(0x130, _MARK, np.uint8)
    for i in range(0x130):
        c = chr(i)
        if c in "\t\n\v\f\r \x85\xa0":
            kind[i] = _GAP
        elif c.isalpha():
            kind[i] = _LETTER
        elif c in "0123456789²³¹¼½¾":
            kind[i] = _DIGIT
    return kind


_KIND = _classes()
_MIX = np.random.default_rng(20_240_601).integers(1, 2**63, 0x10000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of slices of an array of UTF-16 units."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def __call__(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self._up) <= len(units):
            n = max(len(units) + 1, 2 * BLOCK)
            self._up, self._down = _powers(_BASE, n), _powers(_UNBASE, n)
        sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(_MIX[units] * self._up[: len(units)], out=sums[1:])
        return scramble((sums[ends] - sums[starts]) * self._down[starts])


def pieces_of(text: str, most: int = BLOCK) -> Iterator[str]:
    """The text in blocks of about ``most`` characters that end at white space."""
    at = 0
    while len(text) - at > most:
        gap = re.compile(r"[ \t\n]").search(text, at + most)
        if gap is None:
            break
        yield text[at: gap.end()]
        at = gap.end()
    yield text[at:] if at else text


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """The texts as lists of (number of the text, part of it), each list about
    ``most`` characters long."""
    numbers, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces_of(text or "", most):
            numbers.append(i)
            parts.append(part)
            held += len(part) + 1
            if held >= most:
                yield numbers, parts
                numbers, parts, held = [], [], 0
    if parts:
        yield numbers, parts


class PreTokens:
    """Splits texts as the tokenizer in ``path`` does before it looks up pieces."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.normalise = tokenizer.normalizer.normalize_str
        self.splitter = tokenizer.pre_tokenizer[0].pre_tokenize_str
        self.special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.hash = Hasher()

    def _units(self, part: str) -> tuple[np.ndarray, list[int] | None]:
        """The part's lower-case units, and the lengths of its pre-tokens if they were found one by one."""
        if not _ODD.search(part) and not self.special.search(part):
            return np.frombuffer(part.lower().encode("utf-16-le"), np.uint16), None
        words: list[str] = []
        at = 0
        for found in self.special.finditer(part):
            words += self._split(part[at: found.start()])
            words.append(found.group())
            at = found.end()
        words += self._split(part[at:])
        coded = [w.encode("utf-16-le", "surrogatepass") for w in words]
        return np.frombuffer(b"".join(c + b" \0" for c in coded), np.uint16), [len(c) // 2 for c in coded]

    def _split(self, text: str) -> list[str]:
        return [w for w, _ in self.splitter(self.normalise(text))]

    def split(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(units, starts, ends, part, hash): pre-token i of the parts is
        ``units[starts[i]:ends[i]]``, in the order of the texts."""
        arrays, exact, at = [], [], 0
        gap = np.array([32], np.uint16)
        begins = []
        for i, part in enumerate(parts):
            units, lengths = self._units(part)
            begins.append(at)
            if lengths is not None:
                exact.append((i, at, lengths))
            arrays += (units, gap)
            at += len(units) + 1
        units = np.concatenate(arrays) if arrays else gap
        kind = _KIND[np.minimum(units, 0x12F)]
        kind[units >= 0x130] = _LETTER
        fresh = np.empty(len(units), bool)
        fresh[0] = True
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        self._contractions(units, kind, fresh)
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(units))
        words = kind[starts] != _GAP
        starts, ends = starts[words], ends[words]
        begins_at = np.array(begins, np.int64)
        owner = np.searchsorted(begins_at, starts, side="right") - 1
        if exact:
            keep = ~np.isin(owner, [i for i, _, _ in exact])
            more = []
            for i, base, lengths in exact:
                size = np.array(lengths, np.int64)
                first = base + np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if len(size) else size
                more.append((first, first + size, np.full(len(size), i)))
            starts = np.concatenate([starts[keep], *[m[0] for m in more]])
            ends = np.concatenate([ends[keep], *[m[1] for m in more]])
            owner = np.concatenate([owner[keep], *[m[2] for m in more]])
            order = np.argsort(starts, kind="stable")
            starts, ends, owner = starts[order], ends[order], owner[order]
        return units, starts, ends, owner, self.hash(units, starts, ends)

    @staticmethod
    def _contractions(units: np.ndarray, kind: np.ndarray, fresh: np.ndarray) -> None:
        """An apostrophe that starts a run takes 's, 't, 'm, 'd, 're, 've or 'll with it."""
        at = np.flatnonzero((units == 39) & fresh)
        at = at[at + 1 < len(units)]
        for p in at.tolist():
            one = chr(units[p + 1])
            two = one + (chr(units[p + 2]) if p + 2 < len(units) else "")
            size = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") else 0
            if size:
                fresh[p + 1: p + size] = False
                if p + size < len(units):
                    fresh[p + size] = True


def word_at(units: np.ndarray, start: int, end: int) -> str:
    return units[start:end].tobytes().decode("utf-16-le", "surrogatepass")


def words_at(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The pre-tokens at those places (none holds a blank)."""
    if not len(starts):
        return []
    sizes = ends - starts + 1  # with a blank after each
    after = np.cumsum(sizes)
    spread = units[np.minimum(np.repeat(starts - (after - sizes), sizes) + np.arange(after[-1]), len(units) - 1)]
    spread[after - 1] = 32
    return spread[:-1].tobytes().decode("utf-16-le", "surrogatepass").split(" ")


class Encoder:
    """Piece ids of pre-tokens, by the tokenizer itself."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        whole = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        # The words are normalised and split already: only blanks part them.
        self.tokenizer = Tokenizer(whole.model)
        self.tokenizer.pre_tokenizer = Sequence([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = whole.model.end_of_word_suffix
        vocab = whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max([*vocab.values(), *self.specials.values()]) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def flat_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has; a word's last
        piece carries the end-of-word mark."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        groups = [words[i: i + 500] for i in range(0, len(words), 500)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and not any(w in self.specials for w in group):
                flat.append(ids)
                sizes.append(np.diff(cuts, prepend=0))
            else:  # a special token, or a character that the vocabulary lacks: word by word
                each = [[self.specials[w]] if w in self.specials else self.tokenizer.encode(w, add_special_tokens=False).ids for w in group]
                flat.append(np.array([i for ids in each for i in ids], np.uint32))
                sizes.append(np.array([len(ids) for ids in each], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def sizes(self, words: list[str]) -> np.ndarray:
        """The number of ids of each word."""
        return self.flat_ids(words)[1]
