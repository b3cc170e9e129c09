import pytest
from pyspark.sql import functions as F

from millrace.operators import runner
from millrace.sources import records
from millrace.streaming import logs


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "kills": 3}\n\n{"id": "2"}\n')
    assert [(r.id, r.kills) for r in records.read_jsonl(spark, str(p), "id string, kills long").orderBy("id").collect()] == [("1", 3), ("2", None)]
    p.write_text('{"id": "1"\n')
    with pytest.raises(Exception):  # noqa: B017
        records.read_jsonl(spark, str(p), "id string").collect()


def test_pruned_scan(spark, tmp_path):
    path = str(tmp_path / "ext")
    spark.createDataFrame([("A", "1", "s", "t", "easy", 0.5, "x"), ("B", "2", "s", "t", None, None, "x")], "subset string, question_id string, solution string, test string, gpt_difficulty string, gpt_pass_percentage double, more string").write.parquet(path)
    rows = records.read_external(spark, path, ["A"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 1 and "more" not in rows.columns and "PushedFilters: [IsNotNull(subset), EqualTo(subset,A)]" in plan


def test_source_files_and_junit(spark, tmp_path):
    d = tmp_path / "src" / "deep"
    d.mkdir(parents=True)
    (d / "a.py").write_text("x = 1\n")
    (d / "b.py").write_bytes(b"\xff\xfe")
    (d / "c.py").write_text("#" * 300)
    (d / "d.txt").write_text("no")
    assert [r.source for r in records.read_source_files(spark, str(tmp_path / "src"), 200).collect()] == ["x = 1\n"]
    (tmp_path / "r.xml").write_text('<testsuites><testsuite><testcase name="a"/><testcase name="b"><failure message="%s">t</failure></testcase><testcase name="c"><error message="E">t</error></testcase></testsuite></testsuites>' % ("m" * 600))
    got = {r.name: (r.outcome, len(r.message)) for r in records.read_junit(spark, str(tmp_path / "r.xml")).collect()}
    assert got == {"a": ("passed", 0), "b": ("failed", 500), "c": ("error", 1)}


def test_runs_and_frozen_sets(spark, tmp_path):
    run = records.new_run(tmp_path, "eval", seed=3)
    assert records.update_run(run, seed=4, done=True)["seed"] == 4 and records.latest_run(tmp_path, "eval") == run
    art = records.frozen("f", "x = 1\n", "v1", "p", ["compare"], [{"mutant": "m", "equivalent": True}])
    records.write_frozen(tmp_path / "m" / "f.json", art)
    assert records.read_frozen(tmp_path / "m" / "f.json", "v1")["live_count"] == 0
    with pytest.raises(ValueError, match="v1"):
        records.read_frozen(tmp_path / "m" / "f.json", "v2")
    flagged = spark.createDataFrame([("b", True, ["x"]), ("a", False, ["REVIEW y"])], "id string, hard boolean, reasons array<string>")
    records.write_report(tmp_path / "report.md", {"removed": 1}, flagged)
    assert (tmp_path / "report.md").read_text().index("b: x") < (tmp_path / "report.md").read_text().index("a: REVIEW y")


def test_routed_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "valid")], "id long, split string")
    records.write_routed(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "split=valid")).first().id == 2


def test_logs(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string")
    rows.write.json(src)
    stream = lambda: logs.read_log(spark, src, "id long, k string")
    logs.append_log(stream(), out, cp).awaitTermination()
    rows.where("id = 1").withColumn("id", F.lit(3).cast("long")).write.mode("append").json(src)
    logs.append_log(stream(), out, cp).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    q = logs.first_seen(stream(), "k").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.sql("SELECT * FROM firsts").collect()) == ["a", "b"]
    assert [r.id for r in logs.resume(rows, rows.where("id = 1"), "id").collect()] == [2]
    new = spark.createDataFrame([(2, "z"), (5, "n")], "id long, k string")
    assert sorted((r.id, r.k) for r in logs.upsert(rows, new, "id").collect()) == [(1, "a"), (2, "z"), (5, "n")]


SOURCE = "def double(x):\n    return 2 * x\n"


def test_runner_is_off_unless_allowed(spark):
    with pytest.raises(runner.NotAllowed):
        runner.run_suite("", "")
    with pytest.raises(runner.NotAllowed):
        runner.run_rows(spark.range(1))


@pytest.mark.parametrize(
    ("suite", "status", "valid"),
    [
        ("from solution import double\ndef test_a():\n    assert double(2) == 4\n", "ok", True),
        ("from solution import double\ndef test_a():\n    assert double(2) == 5\n", "ok", False),
        ("x = 1\n", "ok", False),
        ("import nothing_of_the_name\n", "crash", False),
    ],
)
def test_runner(suite, status, valid):
    r = runner.run_suite(suite, SOURCE, allow=True, timeout=60)
    assert (r.status, r.valid) == (status, valid)


def test_runner_stops_what_hangs():
    r = runner.run_suite("def test_a():\n    while True: pass\n", SOURCE, allow=True, timeout=2)
    assert r.status == "timeout" and r.kills


def test_repair():
    suite = "from solution import double\n\ndef test_a():\n    assert double(2) == 5\n    assert double(1) == 2\n    assert double('ab') == 'x'\n    assert double(3) < 7\n"
    fixed, stats = runner.repair(suite, SOURCE, allow=True, most_chars=4)
    assert "double(2) == 4" in fixed and "double('ab') == 'x'" in fixed
    assert stats == {"sites": 3, "recorded": 3, "replaced": 1, "already_correct": 1, "too_long": 1, "unliteral": 0, "repr_lengths": [1]}
    assert runner.filled("assert f() == 1\n", {0: "<object>"})[1]["unliteral"] == 1
    assert runner.filled("assert f() == 1\n", {0: "True"})[1]["already_correct"] == 1


def test_import_probe():
    assert runner.imports_cleanly(SOURCE, allow=True, timeout=60)
    assert not runner.imports_cleanly("x = missing_name\n", allow=True, timeout=60)
    with pytest.raises(runner.NotAllowed):
        runner.imports_cleanly(SOURCE)
