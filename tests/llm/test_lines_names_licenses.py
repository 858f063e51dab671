"""Line templates, pseudonyms and licences."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import words
from verity.llm import licenses, line_dedup, pseudonyms, queries

KEY = b"a key"


def test_templates_with_variable_fields_go(spark, docs, rows, empty):
    prose = [" ".join(words(200 + i, 12)) for i in range(8)]
    made = [(i, f"{p}\nlogged in at {i}:4{i} from host{i}\nThis site uses cookies today {w}") for i, (p, w) in enumerate(zip(prose, "a b c d e f g h".split()))]
    made.append((50, None))
    made.append((51, ""))
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert all(got[i].text == prose[i] and got[i].n_dropped == 2 and got[i].n_lines == 3 for i in range(8))
    assert got[50].text is None and got[50].n_lines == 0 and got[51].text == "" and got[51].n_lines == 1
    same = line_dedup.drop_boilerplate(docs)
    assert Counter((r.doc_id, r.text) for r in same.collect()) == Counter((r[0], r[1]) for r in rows)  # copies are no boilerplate
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_line_dedup_is_native(spark):
    plan = queries.op8_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_permutation_is_one_to_one():
    for size in (10, 97, 1000, 73049):
        p = pseudonyms.Permutation(KEY, size, "t")
        images = [p(x) for x in range(min(size, 3000))]
        assert len(set(images)) == len(images) and max(images) < size
        assert [p.invert(y) for y in images] == list(range(len(images)))


def test_formats_hold_and_values_stay_linked():
    names = pseudonyms.Pseudonyms(KEY)
    text = ("call +1 (743) 555-3824 or mail ann.63@mail7.example.com from 152.143.123.131, card 4111 1111 1111 1111, born 1985-03-14 or 31/12/1999, "
            'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"; not 4111111111111112, 300.1.2.3, 2021-13-01.')
    new, spans = names.replaced(text)
    kinds = [k for k, _, _ in spans]
    assert kinds == ["phone", "email", "ip", "card", "date", "date", "secret"]
    found = {k: new[a:b] for k, a, b in spans}
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", found["phone"]) and found["email"].endswith("@mail7.example.com")
    digits = found["card"].replace(" ", "")
    assert re.fullmatch(r"\d{4}( \d{4}){3}", found["card"]) and pseudonyms.check_digit(digits[:-1]) == digits[-1]
    assert all(int(p) < 256 for p in found["ip"].split(".")) and re.fullmatch("[0-9a-f]{40}", found["secret"])
    for old in ("743", "ann.63", "152.143.123.131", "4111 1111 1111 1111", "1985-03-14", "04dbebab"):
        assert old not in new
    assert "4111111111111112, 300.1.2.3, 2021-13-01." in new
    assert names.replaced(f"again 152.143.123.131")[0] == f"again {found['ip']}"
    assert names.replaced("nothing here") == ("nothing here", [])


def test_pseudonyms_of_odd_rows(docs, rows, empty):
    got = pseudonyms.pseudonymised(docs, KEY).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows) and not any(r.n_replaced for r in got)
    assert pseudonyms.pseudonymised(empty, KEY).count() == 0


def test_nearest_ancestor(spark, docs, empty):
    files = spark.createDataFrame([
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "prose"), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/y.py", ""), ("z/q.py", None), ("a/b/own.py", "code\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        (None, "text"), ("top.py", "x"), ("a/b/z.py", " ".join(words(1, 500)))], "path string, text string")
    got = {r.path: (r.license, r.via, r.license_path) for r in licenses.licensed(files).collect()}
    assert got["a/b/c/x.py"] == ("Apache-2.0", "inherited", "a/b/LICENSE") and got["a/b/z.py"] == got["a/b/c/x.py"]
    assert got["a/y.py"] == ("MIT", "inherited", "a/LICENSE") and got["a/b/own.py"] == ("GPL-3.0", "own", "a/b/own.py")
    assert got["z/q.py"] == (None, None, None) == got[None] and got["top.py"] == (None, None, None)
    root = files.unionByName(spark.createDataFrame([("LICENSE", "Licensed under CC BY-NC 4.0.")], "path string, text string"))
    assert {r.path: r.license for r in licenses.licensed(root).collect()}["z/q.py"] == "CC-BY-NC-4.0"
    odd = licenses.licensed(docs.withColumn("path", F.col("source")), carry=["doc_id", "key"])
    assert odd.count() == docs.count() and odd.columns[:2] == ["doc_id", "key"]
    assert licenses.licensed(empty.withColumn("path", F.col("source"))).count() == 0
