"""Near-dedup against all pairs, the toxicity grammar on held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np

from tests.llm.conftest import words
from verity.llm import exact_dedup, near_dedup, queries, toxicity
from verity.llm.components import components


def shingled(text):
    w = (text or "").split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows):
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = sum((a & b).values())
            if (not a and not b) or both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) > 0:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    out = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i, min(known) if known else None, len(ids)] += 1
    return out


def test_classes(docs, rows, empty):
    got = near_dedup.near_classes(docs).collect()
    expected = classes([(r[0], r[1]) for r in rows])
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == expected
    assert sum(r.kept for r in got) == len({(c, n) for _, c, n in expected}) and all(r.doc_id == r.class_id for r in got if r.kept)
    dropped = near_dedup.drop_near_copies(docs)
    assert dropped.schema == docs.schema and dropped.count() == sum(r.kept for r in got)
    assert near_dedup.near_classes(empty).count() == 0


def test_large_group_of_near_copies(spark):
    base = words(5, 200)
    rows = []
    for i in range(60):
        w = list(base)
        w[(7 * i) % 200] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(words(50 + i, 90))) for i in range(20)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, ["doc_id", "text"])).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == classes(rows)


def test_links_between_texts_unlike_the_leader(spark):
    """One hot bucket: copies of a text, some of which resemble only each other."""
    import random
    r, base, rows = random.Random(3), words(6, 240), []
    for i in range(150):
        w = list(base)
        for _ in range(i % 7):
            w[r.randrange(240)] = f"edit{i}x{r.randrange(900)}"
        if i % 3 == 1:
            w = w[: 240 - i % 60]
        if i % 10 in (2, 3):
            at = 12 * (i // 10)
            w[at: at + 14] = [f"own{i // 10}x{k}" for k in range(14)]
        rows.append((i, " ".join(w)))
    got = near_dedup.near_classes(spark.createDataFrame(rows, ["doc_id", "text"])).collect()
    assert Counter((g.doc_id, g.class_id, g.class_size) for g in got) == classes(rows)
    assert len({g.class_id for g in got}) > 3


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, ["a", "b"])).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 5.0, "moron": 4.0})
    kinds = lambda t: [(k, m) for k, m, _ in g.matches(t)]
    assert kinds("you are an idiot") == [("I", "targeted")]
    assert kinds("idiots they all are") == [("I", "targeted")]
    assert kinds("that is not an idiot") == [("I", "denied")]
    assert kinds("he said an idiot came") == [("I", "reported")]
    assert kinds("such a moron of the first water") == [("I", "plain")]
    assert kinds("we will kill you") == [("H", "targeted")]
    assert g.features("no insult here") == g.features("")


def test_toxicity(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op7_toxicity(spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert held[held.toxic == 0].predicted.mean() < 0.01 and held[held.toxic == 1].predicted.mean() > 0.8
    odd = toxicity.toxicity(docs, labels)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_two_variants_in_one_bucket(spark):
    """Copies of a text and of a variant that is unlike it: the variant's copies are
    found by a leader of their own, not by all their pairs."""
    base = words(7, 300)
    variant = [*base[:250], *words(70, 50)]
    rows = []
    for i in range(120):
        w = list(base if i % 3 == 0 else variant)
        w[(11 * i) % 300] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_classes(spark.createDataFrame(rows, ["doc_id", "text"])).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == classes(rows)
    assert len({r.class_id for r in got}) == 2


def test_no_link_lost_whatever_the_number_of_leaders(spark, monkeypatch):
    import random
    r, base, rows = random.Random(8), words(9, 200), []
    for i in range(90):
        w = list(base)
        for at in range(0, 200, 10):
            if r.random() < 0.15:
                w[at: at + 3] = [f"{r.randrange(3)}v{at + k}" for k in range(3)]
        rows.append((i, " ".join(w)))
    for leaders in (0, 1, 6):
        monkeypatch.setattr(near_dedup, "LEADERS", leaders)
        got = near_dedup.near_classes(spark.createDataFrame(rows, ["doc_id", "text"])).collect()
        assert Counter((x.doc_id, x.class_id, x.class_size) for x in got) == classes(rows)


def test_elements_of_one_component_alone_are_left_out(spark):
    """Of the differences from a leader, what one component's texts share with each other only, and
    what only texts like the leader have, is neither ranked nor joined."""
    name = lambda i: bytes([i]) * 16
    strips = lambda *runs: np.sort(np.concatenate([np.arange(a, b, dtype=np.uint64) for a, b in runs])).tobytes()
    texts = {0: strips((0, 100)), 1: strips((0, 40), (200, 260)), 2: strips((0, 41), (200, 260)), 3: strips((0, 30), (300, 370), (200, 205)),
             4: strips((0, 98), (400, 402)), 5: strips((0, 98), (400, 402), (500, 501))}
    sets = spark.createDataFrame([(name(i), bytearray(x)) for i, x in texts.items()], "node binary, strips binary")
    frames = spark.createDataFrame([(name(0), name(i), name(r)) for i, r in ((1, 1), (2, 1), (3, 3), (4, 4), (5, 5))], "leader binary, node binary, root binary")
    seen = near_dedup._rarest(frames, sets).collect()
    assert seen and not {r.part for r in seen} & {*range(205, 260), *range(300, 370), *range(400, 402)}
    assert {r.part for r in near_dedup._crossing(near_dedup._rarest(frames, sets)).collect()} <= {*range(30, 100), *range(200, 205)}


def test_kept_row_among_equals_is_always_the_same(spark):
    text = " ".join(words(12, 40))
    rows = [(1, text, f"s{i}") for i in range(20)]
    for drop in (near_dedup.drop_near_copies, exact_dedup.drop_copies):
        kept = {drop(spark.createDataFrame(some, ["doc_id", "text", "source"]).repartition(n)).first().source for some, n in ((rows, 1), (rows[::-1], 4))}
        assert len(kept) == 1


def test_training_rows_that_repeat_an_identifier(spark):
    """Identifiers that many rows share: no row limit decides which are seen, so the
    order of rows changes no score."""
    texts = [f"you utter blockhead number {i}, go away" if i % 2 else f"a calm walk along the river, day {i}" for i in range(300)]
    rows = [(i % 40, t) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    scores = []
    for some, n in ((rows, 1), (rows[::-1], 5)):
        got = toxicity.toxicity(spark.createDataFrame(some, "doc_id long, text string").repartition(n), labels, training_rows=25).collect()
        scores.append(sorted((r.doc_id, r.score) for r in got))
    assert [i for i, _ in scores[0]] == [i for i, _ in scores[1]] and max(abs(a - b) for (_, a), (_, b) in zip(*scores)) < 1e-9
    assert len({round(s, 6) for _, s in scores[0]}) > 1


def test_each_clause_is_read_once():
    """Against a word-by-word reading of one clause at a time: a clause that follows a
    matched one starts where that one ends."""
    g = toxicity.Grammar({"idiot": 2.0, "moron": 3.0})
    for text in ("you idiot. he is a moron; they said idiot, never mind", "idiot\nmoron\nidiot", "not an idiot! you said: moron? \"idiot\" you moron", "calm. kill you; quiet."):
        found = [m for clause in toxicity._CLAUSE_END.split(text) for m in g.matches(clause)]
        sums = Counter()
        for kind, mood, weight in found:
            sums[kind, mood] += weight
        assert [round(math.expm1(x), 9) for x in g.features(text)[: len(toxicity.PATTERNS)]] == [sums[p] for p in toxicity.PATTERNS]
    assert [m[1] for m in g.matches("you a b c idiot a b c d e idiot")] == ["targeted", "plain"]
    assert [m[1] for m in g.matches("not a b idiot not a b c idiot")] == ["denied", "plain"]
    assert [m[1] for m in g.matches("idiot a b c you said a b c d e f moron")] == ["targeted", "reported"]
