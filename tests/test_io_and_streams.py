"""Readers, writers and streams on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from trajecta.sources import readers, sinks
from trajecta.streaming import twins


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_episodes_and_messages(spark, tmp_path):
    log = {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"text": "HYPOTHESIS: b"}, {"text": "c"}]}]}
    write(tmp_path / "raw/i__1/r1/trajectory.json", json.dumps(log, indent=1))
    write(tmp_path / "raw/i__2/r2/trajectory.json", json.dumps(log))
    write(tmp_path / "raw/i__3/r1/outcome.json", "{}")
    schema = "messages array<struct<role:string,content:string>>"
    got = readers.messages(readers.episodes(spark, str(tmp_path / "raw"), "r1", "trajectory.json", schema))
    assert sorted((r["instance_id"], r["idx"], r["role"], r["text"]) for r in got.collect()) == [("i__1", 0, "user", "a"), ("i__1", 1, "assistant", "HYPOTHESIS: b c")]
    assert readers.inspected(got, ["instance_id"]).first().asDict() == {"instance_id": "i__1", "messages": 2, "assistant": 1, "hypotheses": 1}


def test_jsonl(spark, tmp_path):
    write(tmp_path / "s/r1/audit.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    write(tmp_path / "s/r2/audit.jsonl", '{"a": 3}\n{"a": 4')
    write(tmp_path / "p/pairs_r3_train.jsonl", '{"a": 5}\n')
    torn = readers.jsonl(spark, str(tmp_path / "s/*/audit.jsonl"), "a int", torn=True)
    assert sorted((r["run_id"], r["a"]) for r in torn.collect()) == [("r1", 1), ("r1", 2), ("r2", 3)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.jsonl(spark, str(tmp_path / "s/*/audit.jsonl"), "a int").collect()
    assert readers.jsonl(spark, str(tmp_path / "p/*.jsonl"), "a int", run_from="stem").first()["run_id"] == "r3"
    assert {(r["k"], r["v"]) for r in readers.keyed_rows(spark, _lines(tmp_path, [{"k": 1, "v": 1}, {"k": 1, "v": 2}]), "k").collect()} == {(1, 2)}
    assert readers.dataset_path("full", {"full": "/x"}) == "/x" and readers.dataset_path("/y", {}) == "/y"


def _lines(tmp_path, rows):
    write(tmp_path / "k.jsonl", "\n".join(map(json.dumps, rows)))
    return str(tmp_path / "k.jsonl")


def test_wall_is_loud(spark, tmp_path):
    write(tmp_path / "a.json", '["x", "y"]')
    assert sorted(r[0] for r in readers.wall(spark, [str(tmp_path / "a.json")], [str(tmp_path / "none.json")]).collect()) == ["x", "y"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.wall(spark, [str(tmp_path / "none.json")])


def test_problems(spark, tmp_path):
    row = lambda i, level, day, n: {"id": i, "difficulty": level, "contest_date": f"{day}T00:00", "public_test_cases": "[]", "private_test_cases": json.dumps([{"input": str(k), "output": "o"} for k in range(n)])}
    write(tmp_path / "p.jsonl", "\n".join(json.dumps(x) for x in (row(1, "hard", "2025-01-02", 7), row(2, "easy", "2025-01-02", 2), row(3, "hard", "2024-01-01", 2))))
    schema = "id int, difficulty string, contest_date string, public_test_cases string, private_test_cases string"
    read = lambda **k: readers.problems(spark, str(tmp_path / "p.jsonl"), schema, **k)
    got = read(after="2025-01-01", difficulties=["hard"], most_cases=4).collect()
    assert [r["id"] for r in got] == [1] and [c["input"] for c in got[0]["private"]] == ["0", "1", "5", "6"]
    assert read(after="2099").count() == 0 and read(after="2000").count() == 3


def test_task_dirs(spark, tmp_path):
    for name, toml in (("full", '[environment]\ndocker_image = "im"'), ("bare", "[environment]"), ("bad", "= ="), ("cut", '[environment]\ndocker_image = "im"')):
        write(tmp_path / "tasks" / name / "task.toml", toml)
        write(tmp_path / "tasks" / name / "instruction.md", "do")
        write(tmp_path / "tasks" / name / "solution/solve.sh", "sh")
        if name != "cut":
            write(tmp_path / "tasks" / name / "tests/test.sh", "t")
    got = readers.task_dirs(spark, str(tmp_path / "tasks")).collect()
    assert [(r["task_id"], r["docker_image"], r["instruction.md"]) for r in got] == [("full", "im", "do")]


def test_reports_and_code(spark):
    text = 'log {"tests": [{"name": "a", "status": "ERROR"}, {"name": "a", "status": "PASSED"}, {"name": "b", "status": "FAILED"}, {"status": "PASSED"}]} end'
    df = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select(readers.report_statuses(F.col("t")).alias("m"))
    ok = lambda *n: readers.all_passed(F.array(*map(F.lit, n)), F.col("m"))
    assert [tuple(r) for r in df.select(ok("a").alias("x"), ok("a", "b").alias("y"), ok("z").alias("z")).collect()] == [(True, False, False), (False, False, False), (False, False, False)]
    code = spark.createDataFrame([("i", 2, "b.py", "3-4", "y"), ("i", 1, "a.py", "1-2", "x")], "id string, ord int, file string, lines string, code string")
    assert readers.rendered_code(code, "id").first()["code"] == "# a.py (lines 1-2):\nx\n\n# b.py (lines 3-4):\ny"
    work, done = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert [r["k"] for r in readers.not_done(work, done, "k").collect()] == [1]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "q", "x"), (2, "b", "r", "y")], "id int, type string, u string, v string")
    sinks.fan_out(df, str(tmp_path / "fan"), "type")
    assert spark.read.json(str(tmp_path / "fan/type=a")).count() == 1
    sinks.refresh(df, str(tmp_path / "ref"), "type")
    sinks.refresh(df.filter("type = 'a'").withColumn("u", F.lit("new")), str(tmp_path / "ref"), "type")
    assert {(r["type"], r["u"]) for r in spark.read.parquet(str(tmp_path / "ref")).collect()} == {("a", "new"), ("b", "r")}
    sinks.json_lines(sinks.chat_rows(df, "u", "v", ["type"]), str(tmp_path / "chat"))
    assert spark.read.json(str(tmp_path / "chat")).filter("conversations[0].from = 'human' and conversations[1].from = 'gpt'").count() == 2
    assert sinks.ranking_rows(df, "u", "v", "v", []).first()["chosen"]["from"] == "gpt"
    new = str(tmp_path / "log")
    assert [sinks.append_new(df, new, "id"), sinks.append_new(df, new, "id"), sinks.append_new(df.withColumn("id", F.col("id") + 1), new, "id")] == [2, 0, 1]
    sinks.poison(spark, str(tmp_path / "skip"), df, "id")
    sinks.poison(spark, str(tmp_path / "skip"), spark.createDataFrame([(0,), (2,)], "id int"), "id")
    assert [r["id"] for r in spark.read.json(str(tmp_path / "skip")).orderBy("id").collect()] == [0, 1, 2]
    got = sinks.rewritten(df, {"u": F.upper, "v": lambda c: c}).orderBy("id").collect()
    assert [(r["u"], r["changed"]) for r in got] == [("Q", 1), ("R", 1)]
    sinks.report(df.agg(F.count("*").alias("n")), str(tmp_path / "rep"))
    sinks.sampled_text(df, str(tmp_path / "txt"), "u", "id", 1, "s")
    sinks.mark_done(spark, str(tmp_path / "done"), df, "id", "v2")
    assert spark.read.json(str(tmp_path / "rep")).first()["n"] == 2 and spark.read.text(str(tmp_path / "txt")).count() == 1
    assert spark.read.parquet(str(tmp_path / "done")).filter("version = 'v2'").count() == 2


def test_incremental_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").coalesce(1).write.parquet(src)
    run = lambda: twins.run_available(twins.incremental_rows(spark, src, "k int, v string", "k"), out, ck)
    run()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(2, "d"), (3, "e")], "k int, v string").coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_episode_machine(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "key string, step bigint, state string, resolved boolean"
    rows = [("s", 1, "p", False), ("s", 2, "q", True), ("s", 3, "q", False)] + [("t", i, "same", False) for i in range(1, 6)] + [("u", i, f"p{i}", False) for i in range(1, 10)]
    spark.createDataFrame([r for r in rows if r[1] <= 2], schema).coalesce(1).write.parquet(src)
    run = lambda: twins.run_available(twins.episodes(spark.readStream.schema(schema).parquet(src)), out, ck)
    run()
    spark.createDataFrame([r for r in rows if r[1] > 2], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    got = {(r["key"], r["step"]): (r["rounds"], r["stuck"], r["outcome"]) for r in spark.read.parquet(out).collect()}
    assert got["s", 1] == (1, 0, None) and got["s", 2] == (1, 0, "solved") == got["s", 3]
    assert got["t", 4][1:] == (3, "stuck") and got["t", 3][2] is None
    assert got["u", 7] == (7, 0, None) and got["u", 8] == (7, 0, "exhausted")


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.sql("select timestamp'2025-01-01 00:00:10' as ts, 'a' as k union all select timestamp'2025-01-01 00:02:00', 'a'").write.parquet(src)
    stream = twins.windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(src), "ts", "1 minute", "10 seconds", "k")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").count() == 2


def test_until_quiet():
    from trajecta.streaming.twins import until_quiet

    steps = iter([3, 5, 5, 7, 7, 7, 9])
    assert until_quiet(lambda: next(steps)) == [3, 5, 5, 7, 7, 7]
    assert until_quiet(lambda: 0, quiet=1) == [0, 0]
    count = iter(range(100))
    with pytest.raises(RuntimeError, match="moving"):
        until_quiet(lambda: next(count), most=5)
