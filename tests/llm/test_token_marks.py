"""Rows without identifiers whose texts share a short checksum."""

import zlib
from collections import Counter

from tests.llm.test_tokens import PATH, ids
from verity.llm import token_counts


def test_texts_of_equal_checksums_are_told_apart(spark):
    seen, pairs = {}, []
    for i in range(300_000):
        text = "a" * (i % 7) + f" {i * 7919} b" * (1 + i % 3)
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text and len(ids(other)) != len(ids(text)):
            pairs += [other, text]
    assert pairs
    got = token_counts.token_counts(spark.createDataFrame([(None, t) for t in [*pairs, pairs[0]]], "doc_id long, text string"), PATH).collect()
    assert Counter((r.n_bytes, r.n_tokens) for r in got) == Counter((len(t.encode()), len(ids(t))) for t in [*pairs, pairs[0]])
