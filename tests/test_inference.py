"""One bad prompt fails alone, and odd column names survive."""

from verity.operators.inference import generate


def picky_factory():
    def client(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        if "short" in prompts and len(prompts) > 1:
            return prompts[1:]
        return [p.upper() for p in prompts]
    return client


def test_only_the_bad_rows_fail(spark):
    rows = [(i, "bad one" if i % 7 == 0 else "short" if i == 40 else f"ask {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "`an id: x` long, prompt string")
    got = {r[0]: r for r in generate(df.coalesce(1), "prompt", picky_factory).collect()}
    assert len(got) == 90
    for i, p in rows:
        if "bad" in p:
            assert got[i].response is None and got[i].error == "refused" and got[i].tokens == 2
        else:
            assert got[i].response == p.upper() and got[i].error is None and got[i].tokens == 2 * len(p.split())
