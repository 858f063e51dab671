"""Ids of whole texts by way of their pre-tokens, each asked of the tokenizer once
for as long as a worker remembers it.

What is known lies in flat arrays behind an open table of hashes, so that a block
of some fifty thousand pre-tokens is looked up by a few array operations. The
table holds at most ``REMEMBER`` pre-tokens (some 30 MB); then it starts anew.
"""

from __future__ import annotations

import numpy as np

from verity.llm.pretokens import Encoder, PreTokens, words_at

REMEMBER = 350_000
_BITS = 20  # slots of the table: about three for each pre-token remembered
_PROBES = (np.uint64(43), np.uint64(22), np.uint64(1))
_MASK = np.uint64((1 << _BITS) - 1)


class _Growing:
    """An array that is appended to."""

    def __init__(self, kind: type) -> None:
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            grown = np.zeros(max(2 * len(self.held), self.n + len(more)), self.held.dtype)
            grown[: self.n] = self.held[: self.n]
            self.held = grown
        self.held[self.n: self.n + len(more)] = more
        self.n += len(more)


class Ids:
    def __init__(self, path: str) -> None:
        self.tokens, self.encoder = PreTokens(path), Encoder(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.index = np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.int32)
        self.first, self.size, self.flat = _Growing(np.int64), _Growing(np.int64), _Growing(np.uint32)

    def _places(self, hashes: np.ndarray, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        place, left = np.empty(len(hashes), np.int64), np.arange(len(hashes))
        for probe in _PROBES:
            slot = (hashes[left] >> probe) & _MASK
            hit = (self.keys[slot] == hashes[left]) & (hashes[left] != 0)
            place[left[hit]] = self.index[slot[hit]]
            left = left[~hit]
            if not len(left):
                return place
        new, one, which = np.unique(hashes[left], return_index=True, return_inverse=True)
        at = left[one]
        flat, sizes = self.encoder.flat_ids(words_at(units, starts[at], ends[at]))
        known = self.size.n
        self.first.append(self.flat.n + np.cumsum(sizes) - sizes)
        self.size.append(sizes)
        self.flat.append(flat)
        place[left] = known + which
        self._remember(new, known + np.arange(len(new), dtype=np.int32))
        return place

    def _remember(self, hashes: np.ndarray, places: np.ndarray) -> None:
        for probe in _PROBES:
            slot = (hashes >> probe) & _MASK
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.index[slot[put]] = hashes[put], places[put]
            rest = np.ones(len(hashes), bool)
            rest[put] = False
            hashes, places = hashes[rest], places[rest]

    def __call__(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all parts, ids in each part, hash of each pre-token, part of each pre-token)"""
        units, starts, ends, owner, hashes = self.tokens.split(parts)
        if self.size.n > REMEMBER:
            self.forget()
        at = self._places(hashes, units, starts, ends)
        size = self.size.held[at]
        before = np.cumsum(size) - size
        ids = self.flat.held[np.repeat(self.first.held[at] - before, size) + np.arange(size.sum())]
        return ids, np.bincount(owner, size, len(parts)).astype(np.int64), hashes, owner


_KEPT: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The worker's own for that tokenizer: it lives as long as the worker, so a
    later task need not load the tokenizer nor ask it for the same words again."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Ids(path)
    return _KEPT[path]
