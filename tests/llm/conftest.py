import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("node", T.StringType()), T.StructField("size", T.StringType()), T.StructField("_f", T.StringType()), T.StructField("key", T.LongType()),
])


def words(seed, n):
    import random
    r = random.Random(seed)
    return [r.choice("ba ke li mo nu pra sti ver zon dul".split()) + r.choice("ra te shi ko mu an el or".split()) + r.choice(["", "s", "n"]) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    base = words(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:60], *words(9, 60)]
    long = " ".join(words(2, 30_000))
    texts = {
        1: " ".join(base), 2: "  ".join(base), 3: " ".join(near), 4: " ".join(far), 5: None, 6: "", 7: " \n\t ", 8: long, 9: long + " tail",
        10: "Straße’s café İstanbul 日本 don't 12.5% <|endoftext|> é", 11: "a b c", 12: "a b c", 13: "line one here\nline one here\n" + " ".join(words(3, 80)),
    }
    out = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, "x", "y", "z", 7) for i, t in texts.items()]
    return [*out, out[0], out[0], (None, "only here " + " ".join(words(4, 70)), None, "s1", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
