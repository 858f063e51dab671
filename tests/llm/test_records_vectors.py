"""Binary records, hard negatives and vector codes against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from verity.llm import codes, negatives, records
from verity.llm.crc import Crc32c

PATH = public_tokenizers.path("word_bpe_49k.json")
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
                        T.StructField("row", T.StringType()), T.StructField("vector", T.StringType()), T.StructField("limits", T.StringType())])


def bytewise(data, crc=0xFFFFFFFF):
    for x in data:
        crc ^= x
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert bytewise(b"123456789") == 0xE3069283
    r = np.random.default_rng(1)
    rows = [r.integers(0, 2**32, n, dtype=np.uint32) for n in (0, 1, 2, 3, 7, 8, 100, 1)]
    assert Crc32c()(rows).tolist() == [bytewise(x.tobytes()) for x in rows]
    assert records.EMPTY_RECORD[8:] == Crc32c().masked([np.zeros(2, np.uint32), np.zeros(0, np.uint32)]).astype("<u4").tobytes()


def expected(rows):
    """identifier, ids in ascending order of identifiers; rows that share one in any order."""
    tokenizer = Tokenizer.from_file(PATH)
    coded = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    return sorted(coded, key=lambda x: (x[0] is None, x[0] or 0))


def test_records_round_trip(spark, docs, rows, empty, tmp_path):
    folder, index = str(tmp_path / "records"), str(tmp_path / "index")
    records.write_records(docs, PATH, folder, files=3)
    got = records.with_starts(records.read_records(spark, folder)).orderBy("start").collect()
    told = expected(rows)
    assert [r.doc_id for r in got] == [i for i, _ in told]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    by_id = defaultdict(list)
    for i, ids in told:
        by_id[i].append(np.array(ids, "<u4").tobytes())
    for r in got:
        by_id[r.doc_id].remove(bytes(r.ids))
    assert not any(by_id.values())

    records.write_index(spark, folder, index)
    places = spark.read.parquet(index)
    shuffled = records.records_at(records.epoch_order(places, 5).coalesce(1)).collect()
    assert sorted((bytes(r.ids) for r in shuffled)) == sorted(bytes(r.ids) for r in got)
    again = records.records_at(records.epoch_order(places, 5).coalesce(1)).collect()
    other = records.records_at(records.epoch_order(places, 6).coalesce(1)).collect()
    assert shuffled == again and shuffled != other
    with pytest.raises(Exception, match="damaged"):
        records.records_at(places.withColumn("offset", F.col("offset") + 4)).collect()

    folder = str(tmp_path / "none")
    records.write_records(empty, PATH, folder)
    assert records.read_records(spark, folder).count() == 0


def test_digests_and_files(docs, rows, empty):
    got = records.record_digests(docs, PATH).orderBy("start").collect()
    told = expected(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i is None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in told)
    assert records.record_digests(empty, PATH).count() == 0


def test_no_record_spells_the_line_end():
    framer, crc = records.Framer(), Crc32c()
    spelt = np.frombuffer(records.EMPTY_RECORD, "<u2").astype(np.uint32)
    for ids in (np.append(spelt, 2), np.concatenate([[7], spelt, [2]]), np.array([70_000, 2])):
        framer.add(-5, ids.astype(np.uint32))
    framer.add(None, np.array([2], np.uint32))
    block = framer.block()
    assert records.EMPTY_RECORD not in block
    found = list(records.parsed(block, crc))
    assert [f[0] for f in found] == [-5, -5, -5, None] and [f[2] for f in found] == [9, 10, 2, 1]
    assert np.frombuffer(found[1][5], "<u4").tolist() == [7, *spelt, 2]
    broken = bytearray(block)
    broken[60] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(records.parsed(bytes(broken), crc))


@pytest.fixture(scope="module")
def vectors():
    r, out = random.Random(3), []
    for i in range(900):
        v = [r.gauss(0, 0.4) for _ in range(20)]
        out.append((i, v, None if i % 41 == 7 else r.randrange(4), "x", "y", "z"))
    same = [0.25] * 20
    out += [(1000 + i, same, i % 2, None, None, None) for i in range(300)]  # ties across a third of the rows
    out += [(2000, None, 1, None, None, None), (2100, [0.1, None, *same[2:]], 1, None, None, None), (2200, [math.nan, *same[1:]], 1, None, None, None),
            (2300, [math.inf, *same[1:]], 2, None, None, None), (None, same, 0, None, None, None), (2400, [1.5, -0.001], 0, None, None, None),
            (2500, [], 3, None, None, None), (300, out[300][1], out[300][2], None, None, None), (2600, [-x for x in same], 0, None, None, None)]
    return out


def whole(vector):
    return [math.floor(256 * x) for x in vector] if vector is not None and all(x is not None and math.isfinite(x) for x in vector) else None


def test_negatives(spark, vectors, monkeypatch):
    rows = [(number, i if i is not None else 10**9, whole(v), label) for number, (i, v, label, *_) in enumerate(vectors) if label is not None and whole(v) is not None]
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    told = []
    for at, i, v, label in rows:
        if i % 100 or i == 10**9:
            continue
        scored = sorted((-product(v, w), j, n, other) for n, j, w, other in rows if n != at)
        positives = [s for s in scored if s[3] == label][:5]
        for p in positives:
            within = [s for s in scored if s[3] != label and -80 * p[0] <= -100 * s[0] <= -100 * p[0]][:5]
            told += [(i, p[1] if p[1] < 10**9 else None, k + 1, s[1] if s[1] < 10**9 else None, -p[0], -s[0]) for k, s in enumerate(within)]
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    for group in (1 << 18, 100):
        monkeypatch.setattr(negatives, "GROUP", group)
        got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
        key = lambda rows: sorted(tuple((x is None, x or 0) for x in r) for r in rows)
        assert key(map(tuple, got)) == key(told) and len(told) > 100
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    none = df.where("embedding is null or size(embedding) = 0")
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).count() == 0


def test_packed_products_are_exact():
    r = np.random.default_rng(2)
    for most, width in ((1, 3), (300, 64), (2**20, 7), (2**27, 2)):
        vectors = r.integers(-most, most + 1, (1001, width))
        bound = int((vectors * vectors).sum(1).max())
        packed = negatives.Packed(vectors, int(np.abs(vectors).max()), bound)
        assert (packed.scores(vectors[:5], 3, 990) == vectors[:5] @ vectors[3:990].T).all()


def brute_codes(vectors, width):
    rows = sorted(((i is None, i or 0, w + [0] * (width - len(w))), label) for i, v, label, *_ in vectors if (w := whole(v)) is not None)
    parts = np.array([r[0][2] for r in rows], np.int64).reshape(len(rows), 16, width // 16)
    books = parts[:64].transpose(1, 0, 2).copy()

    def assigned():
        apart = ((parts[:, :, None, :] - books[None]) ** 2).sum(3)
        return apart.argmin(2), apart.min(2).sum(1)
    for _ in range(2):
        code, _ = assigned()
        for p in range(16):
            for e in range(books.shape[1]):
                mine = parts[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(t) // len(mine) for t in mine.sum(0)]
    code, error = assigned()
    labels = defaultdict(int)
    for (_, label), e in zip(rows, error.tolist()):
        labels[label] += e
    return [(None if r[0][0] else r[0][1], "".join(f"{c:02x}" for c in line), e, labels[r[1]]) for r, line, e in zip(rows, code.tolist(), error.tolist())], books


def test_codes(spark, vectors):
    some = [(i, None if v is None else v[:13], *rest) for i, v, *rest in vectors]  # filled up to 16
    for rows, width in ((vectors, 32), (some, 16), (vectors[:20], 32)):
        coded, books = codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3))
        got = codes.with_label_errors(coded).select("vec_id", F.lower(F.hex("code")), "error", "label_error").collect()
        told, right = brute_codes(rows, width)
        key = lambda rows: sorted((r[0] is None, r[0] or 0, *r[1:]) for r in rows)
        assert (books == right).all() and key(map(tuple, got)) == key(told)
        assert codes.codebooks_digest(books) == hashlib.sha256(",".join(str(int(x)) for x in right.ravel()).encode()).hexdigest()
    coded, _ = codes.vector_codes(spark.createDataFrame([], VECTORS))
    assert codes.with_label_errors(coded).count() == 0
    coded, _ = codes.vector_codes(spark.createDataFrame([(1, [], 2, None, None, None)], VECTORS))
    assert [tuple(r) for r in coded.select("vec_id", F.hex("code"), "error").collect()] == [(1, "00" * 16, 0)]


def test_nearest_entries_by_masks():
    r = np.random.default_rng(4)
    for spread, width, entries in ((3, 4, 64), (200, 4, 64), (50, 1, 64), (9, 7, 5)):
        points = r.integers(-spread, spread, (4000, width))
        found, least = codes.Nearest(points[:entries])(points)
        apart = ((points[:, None] - points[:entries][None]) ** 2).sum(2)
        assert (found == apart.argmin(1)).all() and (least == apart.min(1)).all()
