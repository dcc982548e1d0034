import json

import pytest
from pyspark.sql import functions as F

from assaykit import jobs, sources, streaming
from assaykit.operators import aggregates
from assaykit.sources import sinks


def test_json_forms(spark, tmp_path):
    forms = {"list": [{"input": "a"}, {"input": "b"}], "held": {"samples": [{"input": "a"}, {"input": "b"}], "v": 1}, "one": {"input": "a"}}
    for name, value in forms.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        assert sources.read_samples(spark, str(tmp_path / f"{name}.json")).where("input is not null").count() == (1 if name == "one" else 2)
    (tmp_path / "x.jsonl").write_text('{"input": "a"}\n\n{"input": "b"}\n')
    assert sources.read_samples(spark, str(tmp_path / "x.jsonl")).count() == 2


def test_unknown_and_missing(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.read_samples(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        sources.read_samples(spark, str(tmp_path / "gone.csv"))
    (tmp_path / "a.parquet").write_text("")
    (tmp_path / "b.txt").write_text("")
    with pytest.raises(ValueError):
        sources.list_files(str(tmp_path))
    with pytest.raises(ValueError):
        sources.list_files()


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "x"\nline', ["p", "q"]), ("", None, None)]
    df = spark.createDataFrame(rows, "user_id string, agent_response string, trace array<string>")
    sinks.write_csv(df, str(tmp_path / "out.csv"), quote_all=True)
    got = sources.read_agent_csv(spark, str(tmp_path / "out.csv")).select("user_id", "agent_response", "trace").collect()
    assert {(r["user_id"] or "", r["agent_response"]) for r in got} == {("a,b", 'say "x"\nline'), ("", None)}
    assert sorted(r["trace"] or [] for r in got) == [[], ["p", "q"]]


def test_agent_json(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"turn_id": 1, "tool_calls": [{"tool_name": "a", "call_id": "c", "parameters": {}}], "agent_exit": True}, {"turn_id": 2, "tool_calls": None}]))
    got = {r["turn_id"]: r for r in sources.read_agent_json(spark, str(tmp_path / "t.json")).collect()}
    assert got["1"]["tool_calls"][0]["tool_name"] == "a" and got["1"]["agent_exit"] is True and got["2"]["tool_calls"] is None


def test_traces_skip_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"trace_id": "t", "spans": [{"span_id": "s", "attributes": {"k": "v"}}]}))
    (tmp_path / "b.json").write_text('{"trace_id": "u", "spans": [')
    assert [r["trace_id"] for r in sources.read_traces(spark, str(tmp_path)).collect()] == ["t"]


def test_runs_and_results(spark, tmp_path):
    folder = tmp_path / "run1"
    folder.mkdir()
    (folder / "fast.csv").write_text("sample_id,score\n1,0.5\n")
    (folder / "skip.csv").write_text("sample_id,score\n2,0.5\n")
    rows = sources.read_runs(spark, f"{folder}/*.csv", ["skip"]).collect()
    assert [(r["thinking_mode"], r["source_folder"]) for r in rows] == [("fast", "run1")]
    (tmp_path / "r.json").write_text('[{"a": 1},\n{"a": 2}]')
    (tmp_path / "r2.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert sources.read_results(spark, str(tmp_path / "r.json")).count() == sources.read_results(spark, str(tmp_path / "r2.json")).count() == 2


def test_appending_checks_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_checked(spark.range(2), path)
    sinks.append_checked(spark.range(2), path)
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError):
        sinks.append_checked(spark.range(2).withColumnRenamed("id", "x"), path)


def test_reports(spark):
    df = spark.createDataFrame([("<b>", 0.2), ("c", None), ("d", 0.9)], "name string, score double")
    assert "&lt;b&gt;" in sinks.report_html(df, "t") and sinks.report_markdown(df).count("\n") == 4
    assert 'failures="2"' in sinks.report_junit(df, "name", "score", 0.5)


def test_reports_count_what_they_leave_out(spark):
    df = spark.createDataFrame([(f"c{i}", 0.9) for i in range(20)] + [("bad", 0.1), ("none", None)], "name string, score double").coalesce(1)
    xml = sinks.report_junit(df, "name", "score", 0.5, limit=3)
    assert 'tests="22" failures="2"' in xml and 'name="bad"' in xml and 'name="none"' in xml and "19 of 22 rows are left out" in xml
    bad = F.coalesce("score", F.lit(0.0)) < 0.5
    for text in (sinks.report_html(df, "t", 3, bad), sinks.report_markdown(df, 3, bad)):
        assert "bad" in text and "19 of 22 rows are left out" in text


def test_chunks(spark):
    assert [len(c) for c in sources.in_chunks(spark.range(10), 4)] == [4, 4, 2]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "task_id string, s double")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_files(spark, str(tmp_path / "in"), "parquet", "task_id string, s double", 1)
    q = streaming.stream_aggregate(stream, "task_id", ["s"], ("mean", "max")).writeStream.outputMode("complete").format("memory").queryName("agg").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in aggregates.aggregate_by(df, "task_id", ("mean", "max")).collect()}
    assert {tuple(r) for r in spark.table("agg").collect()} == want
    f = streaming.flush(streaming.stream_files(spark, str(tmp_path / "in"), "parquet", "task_id string, s double", 2), str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.where("s >= 10"))
    f.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_job(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"input": q, "expected": a}) for q, a in (("1", "A"), ("2", "B"), ("3", None))))
    spark.createDataFrame([("m", "1", "Answer: A"), ("m", "2", "C")], "model string, prompt string, response string").write.parquet(str(tmp_path / "r"))
    job = jobs.Job({"d": str(tmp_path / "d.jsonl")}, ["m", "n"], ["accuracy", "f1"], str(tmp_path / "r"), output=str(tmp_path / "out"), fail_below=0.4)
    verdict = jobs.run(spark, job)
    assert verdict["passed"] is False and verdict["total"] == 4
    got = {(r["model"], r["scorer"]): r["mean"] for r in spark.read.parquet(str(tmp_path / "out/summary")).collect()}
    assert got["m", "accuracy"] == 0.5 and got["n", "accuracy"] == 0.0
    assert (tmp_path / "out/report.xml").read_text().count("<testcase") == 4
    called = jobs.evaluate(spark, jobs.Job({"d": str(tmp_path / "d.jsonl")}, ["m"], ["exact_match"], call=lambda p: "A"))
    assert called.agg(F.sum("score")).first()[0] == 1.0
    with pytest.raises(ValueError):
        jobs.evaluate(spark, jobs.Job({"d": "x"}, ["m"], ["unknown"]))


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("NAME", "n")
    monkeypatch.setenv("ASSAYKIT_A__B", "2")
    (tmp_path / "c.json").write_text('{"a": {"b": 1, "c": "${NAME}"}}')
    config = jobs.load_config(str(tmp_path / "c.json"))
    assert config == {"a": {"b": "2", "c": "n"}} and jobs.lookup(config, "a.c") == "n" and jobs.lookup(config, "a.x", 5) == 5


def test_presets(spark):
    from assaykit.sources import presets

    squad = spark.createDataFrame([("c", "q", (["a", "b"],)), (None, "q2", ([],))], "context string, question string, answers struct<text: array<string>>")
    assert [(r["input"], r["expected"]) for r in presets.reading_comprehension(squad).orderBy("input").collect()] == [("Context: \nQuestion: q2", ""), ("Context: c\nQuestion: q", "a")]
    swag = spark.createDataFrame([("c", ["x", "y"], 1)], "ctx string, endings array<string>, label int")
    assert presets.sentence_completion(swag).first()["input"] == "c\nChoices:\n0. x\n1. y"
    with pytest.raises(ValueError):
        presets.language_understanding(swag, "none")
    assert len(presets.SUBJECTS) == 57 and len(presets.GLUE_INPUT) == 9


def test_json_arrays(spark, tmp_path):
    import json

    from assaykit.sources import sinks

    df = spark.createDataFrame([(1, "x, \"y\""), (2, None)], "id int, name string")
    assert sinks.write_json_array(df, str(tmp_path / "a.json")) == 2
    assert json.loads((tmp_path / "a.json").read_text()) == [{"id": 1, "name": "x, \"y\""}, {"id": 2}]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 2, "x": [1]}\n')
    assert sinks.jsonl_to_array(spark, str(tmp_path / "b.jsonl"), str(tmp_path / "b.json")) == 2
    assert json.loads((tmp_path / "b.json").read_text()) == [{"id": 1}, {"id": 2, "x": [1]}]
    (tmp_path / "c.jsonl").write_text('{"id": 1}\nnot json\n')
    with pytest.raises(ValueError):
        sinks.jsonl_to_array(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "c.json"))
    assert sinks.write_json_array(df.limit(0), str(tmp_path / "d.json")) == 0 and json.loads((tmp_path / "d.json").read_text()) == []


def test_merging_replaces_a_model(spark, tmp_path):
    from assaykit.sources import sinks

    rows = lambda *r: spark.createDataFrame(list(r), "model string, score double")
    sinks.merge_results(rows(("a", 1.0), ("b", 2.0)), rows(("a", 1.0), ("b", 2.0)), str(tmp_path / "r"))
    sinks.merge_results(rows(("a", 5.0), ("c", 3.0)), rows(("a", 5.0), ("c", 3.0)), str(tmp_path / "r"))
    for name in ("samples", "summary"):
        assert sorted((r["model"], r["score"]) for r in spark.read.parquet(str(tmp_path / "r" / name)).collect()) == [("a", 5.0), ("b", 2.0), ("c", 3.0)]


def test_no_running_median(spark):
    from assaykit import streaming

    with pytest.raises(ValueError):
        streaming.stream_aggregate(spark.createDataFrame([("a", 1.0)], "k string, s double"), "k", ["s"], ("mean", "median"))
