"""Sinks round-trip through storage."""

from pyspark.sql import functions as F

from verity.operators import sinks


def test_append_log_and_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, input string, output string")
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    r = df.withColumn("run_id", F.lit("20250101_000000"))
    sinks.write_results(r, str(tmp_path / "res"))
    back = spark.read.json(str(tmp_path / "res"))
    assert back.count() == 2 and "run_id" in back.columns


def test_csv_round_trip_and_latest(spark, tmp_path):
    df = spark.createDataFrame([("m0", "Simple", 5)], "model string, complexity string, query_count int")
    sinks.write_table_csv(df, str(tmp_path / "t"))
    back = sinks.read_table_csv(spark, str(tmp_path / "t"), df.schema)
    assert back.collect() == df.collect()
    runs = spark.createDataFrame([("comparison_table", "20250101_000000"), ("comparison_table", "20250102_000000")],
                                 "kind string, run_id string")
    assert sinks.latest_run(runs).first().latest_run_id == "20250102_000000"


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("sql", "raw", 12.34, 50.0, 120.0, 42.0)],
                               "task_type string, approach string, exact_match_pct double, "
                               "execution_match_pct double, time_ms double, tokens double")
    lines = sinks.report_lines(df, "Performance Analysis by SQL Task Type", "task_type", ["task_type", "approach"])
    sinks.write_report(lines, str(tmp_path / "rep"))
    text = [r.value for r in spark.read.text(str(tmp_path / "rep")).collect()]
    assert text[0].startswith("# Performance") and "| sql | raw | 12.3% | 50.0% | 120.0 | 42.0 |" in text


def test_rerun_replaces_its_run_only(spark, tmp_path):
    cells = spark.createDataFrame([("r1", "m0", "simple", "raw", 0.5, 3), ("r1", "m0", "simple", "few_shot", 0.75, 4), ("r1", "m1", None, "raw", None, 1),
                                   ("r2", "m0", "extra", "raw", 1.0, 9)], "run_id string, model string, complexity string, approach string, exact double, n long")
    tree = sinks.results_tree(cells)
    path = str(tmp_path / "tree")
    sinks.write_results(tree, path)
    sinks.write_results(tree.filter("run_id = 'r1'"), path)  # a rerun
    schema = "run_id string, tree map<string,map<string,map<string,struct<exact:double,n:bigint>>>>"
    back = {r.run_id: r.tree for r in spark.read.schema(schema).json(path).collect()}
    assert {m: {lv: {a: (x.exact, x.n) for a, x in by.items()} for lv, by in t.items()} for m, t in back["r1"].items()} == {
        "m0": {"simple": {"raw": (0.5, 3), "few_shot": (0.75, 4)}}, "m1": {"unknown": {"raw": (None, 1)}}}
    assert back["r2"]["m0"]["extra"]["raw"].n == 9 and len(back) == 2
    assert sinks.results_tree(cells.limit(0)).count() == 0


def test_log_stream_logs_each_request_once(spark, tmp_path):
    src, path, check = (str(tmp_path / n) for n in ("src", "log", "check"))
    schema = "request_id int, ts timestamp, output string"

    def arrive(*rows):
        spark.createDataFrame(rows, "request_id int, ts string, output string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode(
            "append").parquet(src)
        sinks.run_log_stream(spark.readStream.schema(schema).parquet(src), path, check).awaitTermination()

    def logged():
        return sorted((r.request_id, r.output) for r in spark.read.parquet(path).collect())

    arrive((1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 10:05:00", "b"))
    assert logged() == [(1, "a"), (2, "b")]
    arrive((2, "2024-01-01 10:05:00", "b"), (3, "2024-01-01 14:00:00", "c"))  # after a restart
    assert logged() == [(1, "a"), (2, "b"), (3, "c")]
    arrive((4, "2024-01-01 10:01:00", "late"), (5, "2024-01-01 14:10:00", "e"))
    assert logged() == [(1, "a"), (2, "b"), (3, "c"), (5, "e")]
    last = spark.read.parquet(path).filter("request_id = 5")
    epoch = last.first().epoch
    sinks.write_log_epoch(spark.createDataFrame(last.drop("epoch").collect(), schema), epoch, path)  # the epoch once more
    assert logged() == [(1, "a"), (2, "b"), (3, "c"), (5, "e")]
