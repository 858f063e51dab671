"""Bodies that cannot be read become rows with an error."""

from verity.operators.requests import parse_bodies


def test_each_error(spark):
    bodies = ['{"k": 1, "t": "a"}', '{"t": "a"}', '{"k": "one", "t": "a"}', '{"k": 1', "", None, "[1]", "7", "no", " {\"k\": 2}"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, `my.body` string").coalesce(1)
    got = {r.id: (r.parsed and (r.parsed.k, r.parsed.t), r.error) for r in parse_bodies(df, "my.body", "k bigint, t string").collect()}
    bad = "malformed JSON"
    assert got == {0: ((1, "a"), None), 1: ((None, "a"), None), 2: ((None, "a"), "wrong type"), 3: (None, bad), 4: (None, bad), 5: (None, "missing body"),
                   6: (None, "not an object"), 7: (None, "not an object"), 8: (None, bad), 9: ((2, None), None)}
    assert parse_bodies(df.limit(0), "my.body", "k bigint").count() == 0
