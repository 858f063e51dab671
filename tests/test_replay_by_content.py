"""Calls answered by content, live retries in rounds, and dependent calls."""

from pyspark.sql import functions as F

from verity.functions import text as T
from verity.operators import inference, poems, replay, responses


def test_latest_recording_and_hot_prompts(spark):
    rows = [("m0", "hot", "old", None, 1), ("m0", "hot", "new", None, 2), ("m1", "hot", "other", "late", 1), ("m0", "cold", "yes", None, 1), (None, "cold", "any", None, 1)]
    rows += [("m0", f"p{i}", f"r{i}", None, i) for i in range(400)] + [("m0", None, "never", None, 9)]
    store = responses.latest_recordings(spark.createDataFrame(rows, "model string, prompt string, response string, error string, at int"), "at")
    calls = [(i, "m0", "hot") for i in range(900)] + [(1000 + i, "m0", f"p{i}") for i in range(450)]
    calls += [(2000, "m1", "hot"), (2001, "m1", "cold"), (2002, None, "cold"), (2003, "m0", None), (2003, "m0", None)]
    told = responses.replayed(spark.createDataFrame(calls, "id int, model string, prompt string").repartition(4), store).collect()
    assert len(told) == len(calls)
    by = {r.id: (r.response, r.error) for r in told}
    assert all(by[i] == ("new", None) for i in range(900))
    assert all(by[1000 + i] == ((f"r{i}", None) if i < 400 else (None, "no response")) for i in range(450))
    assert by[2000] == ("other", "late") and by[2001] == (None, "no response") and by[2002] == ("any", None) and by[2003] == (None, "no prompt")
    empty = spark.createDataFrame([], "id int, model string, prompt string")
    assert responses.replayed(empty, store).count() == 0


def test_prompts_that_share_a_hash_are_not_mixed_up(spark, monkeypatch):
    monkeypatch.setattr(responses, "prompt_key", lambda prompt: F.lit("same") + F.lit("") if prompt is None else F.when(prompt.isNotNull(), "same"))
    store = responses.latest_recordings(spark.createDataFrame([("m", "a", "A", None, 1), ("m", "b", "B", None, 1)],
                                                              "model string, prompt string, response string, error string, at int"), "at")
    told = responses.replayed(spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "c")], "model string, prompt string"), store).collect()
    assert {(r.prompt, r.response) for r in told} == {("a", "A"), ("b", "B"), ("c", None)}


def answers_on(n):
    """A client that names a sentiment on a request's n-th call (the request's number is n)."""
    def factory():
        def client(prompts):
            out = []
            for p in prompts:
                number, call = (int(x) for x in p.split()[:2])
                out.append("so positive" if call == number else "hm")
            return out
        return client
    return factory


def test_live_rounds_equal_the_replayed_policy(spark, tmp_path):
    requests = spark.createDataFrame([(i,) for i in (1, 2, 5, 13, 14, 20)], "request_id int")
    prompts = [F.concat_ws(" ", F.col("request_id").cast("string"), F.lit(str(k)), F.lit("how is it")) for k in range(1, 14)]
    label = T.sentiment_label("response")
    asked = spark.sparkContext.accumulator(0)

    def answer(calls):
        asked.add(calls.count())
        return inference.generate(calls, "prompt", answers_on(0))

    live = responses.in_rounds(requests, "request_id", prompts, label.isNotNull(), answer, str(tmp_path / "rounds"))
    got = {r.request_id: (r.s, r.calls) for r in live.select("request_id", F.coalesce(label, F.lit("neutral")).alias("s"), "calls").collect()}
    attempts = spark.createDataFrame([(i, k, "so positive" if k == i else "hm") for i in (1, 2, 5, 13, 14, 20) for k in range(1, 21)], "request_id int, at int, response string")
    told = {r.request_id: (r.sentiment, r.calls) for r in replay.select_sentiment(attempts, order=("at",)).collect()}
    assert got == told == {1: ("positive", 1), 2: ("positive", 2), 5: ("positive", 5), 13: ("positive", 13), 14: ("neutral", 13), 20: ("neutral", 13)}
    # only requests without an answer were asked again
    assert asked.value == 6 + 5 + 4 * 3 + 3 * 8


def test_rounds_that_repeat_a_prompt_are_counted_not_made(spark, tmp_path):
    made = []

    def answer(calls):
        made.append(calls.count())
        return calls.withColumns({"response": F.lit("hm"), "error": F.lit(None).cast("string")})

    plain, pressed = F.lit("a"), F.lit("b")
    told = responses.in_rounds(spark.range(3).withColumnRenamed("id", "request_id"), "request_id", [plain, pressed, pressed, plain], F.lit(False), answer,
                               str(tmp_path / "rounds"), repeatable=True).collect()
    assert made == [3, 3] and {(r.calls, r.accepted) for r in told} == {(4, False)} and len(told) == 3


def test_poems_of_all_lengths(spark):
    rows = [(1, "m", "a\nb\nc\nd\ne"), (2, "m", "a\n\nb\nc\nd\ne\nf"), (3, "m", "a\nb\nlast"), (4, "m", "unknown"), (5, "m", ""), (6, "m", None), (7, "m", "a\nb\nc\nd")]
    df = spark.createDataFrame(rows, "id int, model string, text string")
    recorded = [("m", "generate me 2 line poem whose previous line is last", "more\nlines", None, 1), ("m", "generate me 1 line poem whose previous line is d", "end", None, 1)]
    store = responses.latest_recordings(spark.createDataFrame(recorded, "model string, prompt string, response string, error string, at int"), "at")
    told = {r.id: (r.poem, r.asked, r.error) for r in poems.five_lines(df, "text", lambda calls: responses.replayed(calls, store)).collect()}
    assert told[1] == told[2] == ("a\nb\nc\nd\ne", False, None)
    assert told[3] == ("a\nb\nlast\nmore", True, None) and told[7] == ("a\nb\nc\nd\nend", True, None)
    assert told[4] == ("unknown", True, "no response") and told[5] == ("", True, "no response") and told[6][1:] == (True, "no response")
