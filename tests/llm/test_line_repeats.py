"""Lines that two texts share, and leaves with several templates."""

import random
import re

from tests.llm.conftest import words
from verity.llm import line_dedup


def left(spark, texts):
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in line_dedup.drop_boilerplate(made).collect()}


def test_passages_of_two_texts_go(spark):
    passage, short = " ".join(words(700, 60)), "shared by both texts"
    own = [" ".join(words(701 + i, 20)) for i in range(4)]
    got = left(spark, [f"{own[0]}\n{passage}\n{short}", f"{short}\n{own[1]}\n{passage}", own[2], own[3] + "\n" + own[3]])
    assert got == {0: own[0], 1: own[1], 2: own[2], 3: own[3] + "\n" + own[3]}


def test_copies_but_for_white_space_stay(spark):
    lines = [" ".join(words(710 + i, 20)) for i in range(3)]
    texts = ["\n".join(lines), "\n\n".join(lines), " \n".join(lines) + "\n"]
    assert left(spark, texts) == dict(enumerate(texts))


def test_several_templates_among_unrelated_lines_of_one_leaf(spark):
    draw = random.Random(5)
    names = [f"name{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)]
    shapes = [" ".join(words(800 + k, 9)) for k in range(6)]
    for n, unrelated in ((6, 60), (24, 600)):
        texts, keep = [], {}
        for i in range(6 * n):
            own = " ".join(words(10_000 + i, 15))
            keep[len(texts)] = own
            texts.append(f"{own}\nyou are now {shapes[i % 6]} {draw.choice(names[:40])} ok")
        for i in range(unrelated):
            keep[len(texts)] = "you are now " + " ".join(words(50_000 + i, 11))
            texts.append(keep[len(texts)])
        got = left(spark, texts)
        assert sum(got[i] != t for i, t in keep.items()) == 0


def test_field_values_that_other_templates_share(spark):
    names = [f"name{chr(97 + i)}x" for i in range(12)]
    texts, keep = [], {}
    for k in range(30):
        shape = " ".join(words(900 + k, 8))
        for i in range(5):
            keep[len(texts)] = " ".join(words(20_000 + 5 * k + i, 15))
            texts.append(f"{keep[len(texts)]}\nthis page for {shape} {names[(k + 2 * i) % 12]}")
    got = left(spark, texts)
    assert sum(got[i] != t for i, t in keep.items()) == 0


def test_fields_and_spaces_as_read_word_by_word(spark):
    """Lines are told by their tokens, those with a digit as one, whatever stands between them."""
    draw = random.Random(9)
    parts = ["a", "bc", "0", "x0", "7x", "x7", "é9é", "٣", " ", " ", "  ", "\t", "\x0b", "\f", "\r", "\n", "\x85", "ab1c0", "10"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(40))) for _ in range(400)]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "mark string, text string")
    got = {(int(r.mark), r.at): (r.own, r.leaf) for r in line_dedup.line_table(line_dedup.marked_texts(rows)).collect()}
    want = {}
    for i, t in enumerate(texts):
        for at, line in enumerate(t.split("\n")):
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
            if len(words) >= line_dedup.MIN_TOKENS:
                want[i, at] = tuple("0" if re.search("[0-9]", w) else w for w in words)
    assert got.keys() == want.keys()
    own, leaf = {}, {}
    for k, w in want.items():
        assert own.setdefault(w, got[k][0]) == got[k][0] and leaf.setdefault((len(w), w[:line_dedup.DEPTH]), got[k][1]) == got[k][1]
    assert len(set(own.values())) == len(own) > 100 and len(set(leaf.values())) == len(leaf)


def test_texts_are_marked_once_before_the_shuffle(spark):
    """The two uses of the lines read marked texts; neither has a pattern of its own for fields."""
    rows = spark.createDataFrame([("1", "some line of 3 words", 5)], "mark string, text string, body long")
    plan = line_dedup.line_table(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "regexp_extract_all" not in plan
