"""Token counts and packing against the tokenizer itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from verity.llm import packing, token_counts
from verity.llm.pretokens import BLOCK, pieces_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_counts(docs, rows, empty):
    got = token_counts.token_counts(docs, PATH).collect()
    expected = Counter((r[0], len((r[1] or "").encode()), len(ids(r[1])), len(ids(r[1])) > 2048) for r in rows)
    assert Counter(map(tuple, got)) == expected
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_rare_pretokens_meet_in_the_join(docs, rows, monkeypatch):
    monkeypatch.setattr(token_counts, "COMMON", 20)  # hardly any pre-token is common
    got = token_counts.token_counts(docs, PATH).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len(ids(r[1]))) for r in rows)


def test_packing(docs, rows, empty):
    got = packing.packed(docs, PATH).toPandas().sort_values(["sequence_id", "offset"])
    at = got.sequence_id * 4096 + got.offset
    assert (at.values == np.concatenate([[0], np.cumsum(got.length.values)[:-1]])).all() and (got.offset + got.length <= 4096).all()
    known = defaultdict(list)
    for r in rows:
        known[-1 if r[0] is None else r[0]].append(np.array([*ids(r[1]), 2], "<u4"))
    assert got.length.sum() == sum(len(x) for some in known.values() for x in some)
    for r in got.itertuples():
        whole = [x for x in known[-1 if np.isnan(r.doc_id) else int(r.doc_id)] if len(x) == r.doc_tokens]
        assert any(zlib.crc32(x[r.start: r.start + r.length].tobytes()) == r.ids_crc32 for x in whole)
    assert packing.packed(empty, PATH).count() == 0


def test_hilbert_neighbours_touch():
    bits, old = 3, packing.BITS
    packing.BITS = bits
    try:
        grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)], float)
        points = np.arctanh((grid + 0.5) / 8 * 2 - 1)
        class Same:
            def __matmul__(self, _):
                return points
            __truediv__ = lambda self, _: self
        real = np.linalg.norm
        np.linalg.norm = lambda *a, **k: np.ones((512, 1))
        try:
            keys = packing.hilbert_keys(Same())
        finally:
            np.linalg.norm = real
    finally:
        packing.BITS = old
    assert sorted(keys) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_long_texts_are_cut_at_white_space():
    text = ("word " * BLOCK)[: 3 * BLOCK]
    parts = list(pieces_of(text))
    assert len(parts) > 1 and "".join(parts) == text and all(p.endswith(" ") for p in parts[:-1])
    assert list(pieces_of("x" * (2 * BLOCK))) == ["x" * (2 * BLOCK)]
