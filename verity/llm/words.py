"""64-bit hashes of the words of many texts at once, and of their shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from verity.llm.pretokens import BLOCK, Hasher, blocks, scramble

SHINGLE = 5
_PLACE = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _part_words(hasher: Hasher, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all parts (runs without ``[\\x20\\x09-\\x0D]``), and how many each part has."""
    coded = [p.encode("utf-16-le", "surrogatepass") for p in parts]
    units = np.frombuffer(b" \0".join(coded) + b" \0", np.uint16)
    gap = (units == 32) | ((units >= 9) & (units <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    begins = np.concatenate([[0], np.cumsum([len(c) // 2 + 1 for c in coded])])
    return hasher(units, starts, ends), np.diff(np.searchsorted(starts, begins))


def word_hashes(texts: list[str], most: int = BLOCK) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(numbers of texts, word hashes of each): whole texts, in groups of about ``most`` characters."""
    hasher, open_at, open_parts, numbers, groups, held = Hasher(), -1, [], [], [], 0
    for some, parts in blocks(texts, most):
        hashes, sizes = _part_words(hasher, parts)
        for number, words in zip(some, np.split(hashes, np.cumsum(sizes)[:-1])):
            if number != open_at:
                if open_at >= 0:
                    numbers.append(open_at)
                    groups.append(np.concatenate(open_parts))
                    held += len(groups[-1])
                    if held * 6 >= most:
                        yield numbers, groups
                        numbers, groups, held = [], [], 0
                open_at, open_parts = number, []
            open_parts.append(words)
    if open_at >= 0:
        yield [*numbers, open_at], [*groups, np.concatenate(open_parts)]


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the windows of ``size`` words; of fewer words, one of them all; of none, none."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += scramble(words[k: n - width + 1 + k] + _PLACE[k]) * _PLACE[k + 32]
    return scramble(out + np.uint64(width))


def strips(shingled: np.ndarray) -> np.ndarray:
    """A multiset of hashes as a set: the i-th copy of an element becomes an
    element of its own, so weights turn into strips of height one."""
    ordered = np.sort(shingled)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    copy = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
    return scramble(ordered + copy.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
