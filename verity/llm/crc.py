"""CRC-32C (Castagnoli) of many rows of 32-bit words at once.

The checksum is linear: a word's part in it is that word, moved on by the words
that follow. Neighbours are therefore joined pairwise, the left one moved by as
many words as the right one holds, until one word a row is left. Rows of unequal
length are filled up in front by zeros, which a sum that starts at zero ignores.
"""

from __future__ import annotations

import numpy as np

_POLYNOMIAL = 0x82F63B78  # fixed value: Castagnoli's, bits reversed
_MASK_DELTA = np.uint32(0xA282EAD8)  # fixed value of the record format
_ALL = np.uint32(0xFFFFFFFF)


def _after_a_word(x: int) -> int:
    for _ in range(32):
        x = (x >> 1) ^ (_POLYNOMIAL if x & 1 else 0)
    return x


def _tables(columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A linear map of 32 bits, given by its columns, as a table for each half."""
    halves = []
    for half in (columns[:16], columns[16:]):
        table = np.zeros(1 << 16, np.uint32)
        for bit, column in enumerate(half):
            table[1 << bit: 2 << bit] = table[: 1 << bit] ^ np.uint32(column)
        halves.append(table)
    return halves[0], halves[1]


def _moved(x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return tables[0][x & np.uint32(0xFFFF)] ^ tables[1][x >> np.uint32(16)]


class Crc32c:
    def __init__(self) -> None:
        self.moves = [_tables([_after_a_word(1 << b) for b in range(32)])]  # by 1, 2, 4 ... words

    def _move(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.moves) <= level:
            last = self.moves[-1]
            columns = np.array([1 << b for b in range(32)], np.uint32)
            self.moves.append(_tables(_moved(_moved(columns, last), last).tolist()))
        return self.moves[level]

    def __call__(self, rows: list[np.ndarray]) -> np.ndarray:
        """The checksum of each row, an array of little-endian 32-bit words."""
        out = np.zeros(len(rows), np.uint32)  # of no bytes: 0
        sizes = np.array([len(r) for r in rows], np.int64)
        levels = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for level in np.unique(levels[sizes > 0]).tolist():
            of = np.flatnonzero((levels == level) & (sizes > 0))
            width = 1 << level
            step = max(1, (1 << 15) // width)
            for some in (of[i: i + step] for i in range(0, len(of), step)):
                words = np.zeros((len(some), width), np.uint32)
                for at, i in enumerate(some.tolist()):
                    words[at, width - len(rows[i]):] = rows[i]
                words[np.arange(len(some)), width - sizes[some]] ^= _ALL
                for k in range(level):
                    words = _moved(words[:, ::2], self._move(k)) ^ words[:, 1::2]
                out[some] = _moved(words[:, 0], self._move(0)) ^ _ALL
        return out

    def masked(self, rows: list[np.ndarray]) -> np.ndarray:
        """Checksums as records hold them: turned by 15 bits, plus a constant."""
        crc = self(rows)
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + _MASK_DELTA
