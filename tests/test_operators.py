import json

import pytest
from pyspark.sql import functions as F

from assaykit.operators import aggregates, agents, conversation, generation, judging, requests, retrieval, samples, stages


def test_aggregates_of_missing_scores(spark):
    df = spark.createDataFrame([("t", "u", "1", "why"), ("t", "v", "x", "why"), (None, "u", "5", "why"), ("e", "u", None, "why")], "task_id string, user_id string, s string, s_reasoning string")
    got = {r["task_id"]: (r["mean_s"], r["max_s"]) for r in aggregates.aggregate_by(df, "task_id", ("mean", "max")).collect()}
    assert got == {"t": (1.0, 1.0), "e": (0.0, 0.0)}


def test_any_function_as_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None)], "agent_name string, s double")
    spread = aggregates.grouped_callable("spread", lambda xs: max(xs) - min(xs) if xs else 0.0)
    got = {r["agent_name"]: r["spread_s"] for r in aggregates.aggregate_by(df, "agent_name", {"spread": spread}).collect()}
    assert got == {"a": 3.0, "b": 0.0}


def test_main_value_of_structs(spark):
    df = spark.createDataFrame([((0.1, 0.2, 0.9),), ((None, float("nan"), None),)], "s struct<precision: double, recall: double, score: double>")
    assert [r[0] for r in df.select(aggregates.main_value(F.col("s"), ["precision", "recall", "score"])).collect()] == [0.9, 0.0]
    assert df.select(aggregates.main_value(F.col("s"), ["precision", "recall"])).first()[0] == 0.1


def test_best_model_first_of_ties(spark):
    df = spark.createDataFrame([("b", "1", "s", 1.0), ("a", "1", "s", 1.0), ("c", "1", "s", 0.5)], "model string, sample_id string, scorer string, score double")
    assert aggregates.best_models(df).first()["model"] == "a"


def test_panel_of_one_and_zero_weights(spark):
    votes = spark.createDataFrame([("x", "j", 0.0, 0.4), ("y", "j", 0.0, 0.2), ("y", "k", 0.0, 0.8)], "sample_id string, judge string, weight double, score double")
    got = {r["sample_id"]: r for r in aggregates.panel(votes).collect()}
    assert got["x"]["consensus_level"] == 1.0 and got["y"]["weighted_mean"] == 0.5 and got["y"]["majority"] == 0.0


def test_empty_requests_are_zeros(spark):
    empty = spark.createDataFrame([], "latency double, ttfb double, tokens_input long, tokens_output long, cost double, success boolean, error_type string, provider string, model string")
    assert set(requests.request_metrics(empty).first().asDict().values()) == {0, 0.0}
    assert {r["n"] for r in requests.latency_histogram(empty).collect()} == {0}


def test_percentile_and_buckets(spark):
    rows = [(float(x), None, 1, 1, None, True, None, "p", "m") for x in range(10, 101, 10)] + [(-5.0, None, None, None, None, False, "", "", None), (900.0, None, None, None, None, False, None, "p", "")]
    df = spark.createDataFrame(rows, "latency double, ttfb double, tokens_input long, tokens_output long, cost double, success boolean, error_type string, provider string, model string")
    assert requests.request_metrics(df.where("success")).first()["latency_p50"] == 55.0
    got = {r["bucket"]: r["n"] for r in requests.latency_histogram(df).collect()}
    assert got["0-100ms"] == 9 and got["100-200ms"] == 1 and got["900ms+"] == 1 and sum(got.values()) == 11
    assert [tuple(r) for r in requests.error_breakdown(df).collect()] == [("unknown", 2)]
    assert {(r["level"], r["key"]) for r in requests.metric_levels(df).collect()} == {("overall", "all"), ("provider", "p"), ("model", "m")}


def test_ranking_edge_cases(spark):
    df = spark.createDataFrame([([1, 2, 3], [1.0, 0.0, 1.0]), ([2], [1.0]), ([], []), (None, None), ([1, 2], [0.5, 2.0])], "r array<int>, l array<double>")
    got = [r["s"] for r in df.select(retrieval.ranking_scores(F.col("r"), F.col("l")).alias("s")).collect()]
    assert got[0]["mrr"] == 1.0 and round(got[0]["map"], 6) == round((1 + 2 / 3) / 2, 6)
    assert got[1]["ndcg"] == 0.0 and got[1]["mrr"] == 0.5
    assert got[2]["combined"] == 0.0 and got[3]["combined"] == 0.0
    assert got[4]["map"] == 0.0 and 0 < got[4]["ndcg"] < 1


def test_group_diversity_equals_pairs(spark):
    vectors = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0], [-1.0, 0.5]]
    df = spark.createDataFrame([("a", v) for v in vectors] + [("b", [1.0, 2.0])], "g string, v array<double>")
    got = {r["g"]: (r["n"], r["diversity"]) for r in retrieval.group_diversity(df, "g", "v").collect()}
    lists = df.where("v <> array(0D, 0D)").groupBy("g").agg(F.collect_list("v").alias("v"))
    want = {r["g"]: r["d"] for r in lists.select("g", retrieval.embedding_diversity(F.col("v")).alias("d")).collect()}
    assert abs(got["a"][1] - want["a"]) < 1e-9 and got["a"][0] == 4 and got["b"] == (1, 0.0)


def test_rating_scorers_guards(spark):
    df = spark.createDataFrame([("", "c", "5"), ("o", None, "5"), ("o", "one", "5"), ("o", "one\n\ntwo", "5")], "o string, c string, r string")
    col = lambda n: [r[0] for r in df.select(generation.rating_score(n, F.col("r"), F.col("o"), F.col("c"))).collect()]
    assert col("conflict_resolution") == [0.0, 0.0, 1.0, 1.0]
    assert col("context_groundedness") == [0.0, 0.0, 1.0, 1.0]
    assert col("hallucination_detection") == [0.0, 0.2, 0.2, 0.2]
    items = df.select(generation.rating_score("claim_verification", F.array().cast("array<string>"), F.col("o"))).collect()
    assert [r[0] for r in items] == [0.0, 1.0, 1.0, 1.0]
    assert len(generation.SCORERS) == 21


def test_typed_turns(spark):
    df = spark.createDataFrame([(' [{"tool_name": "a", "parameters": {"q": 1}, "call_id": "c"}] ', "On"), ("plain", "perhaps"), ("[broken", None), (None, None)], "calls string, agent_exit string")
    got = agents.typed_turns(df, {"tool_calls": "calls"}).select("tool_calls", "tool_calls_raw", "agent_exit", "agent_exit_raw", "trace").collect()
    assert got[0]["tool_calls"][0]["tool_name"] == "a" and json.loads(got[0]["tool_calls"][0]["parameters"]) == {"q": 1} and got[0]["agent_exit"] is True
    assert [r["tool_calls_raw"] for r in got] == [None, "plain", "[broken", None] and got[1]["agent_exit_raw"] == "perhaps"


def test_last_result_of_a_call_wins(spark):
    df = spark.createDataFrame([("t", [("a", "{}", "1"), ("b", "{}", "2")], [("1", "x", True, None), ("1", "y", False, None)])], f"turn_id string, tool_calls array<{agents.CALL}>, tool_call_results array<{agents.RESULT}>")
    assert [(r["tool_name"], r["result"]) for r in agents.calls_with_results(df, ["turn_id"]).orderBy("pos").collect()] == [("a", "y"), ("b", None)]


def test_agent_gates(spark):
    df = spark.createDataFrame([("x", True, "score: 9"), ("x", False, "score: 9"), (None, True, "score: 9")], "trace string, done boolean, r string")
    got = [r["s"] for r in df.select(agents.agent_score("goal_achievement", F.col("r"), {"trace": F.col("trace")}, F.col("done")).alias("s")).collect()]
    assert [(s["score"], s["valid"], s["missing"]) for s in got] == [(9.0, True, []), (-1.0, False, []), (0.0, False, ["trace"])]


def test_span_turns(spark):
    spans = [("t", "a", "1", {"agent.input.query": "q", "agent.input.topic": "z", "llm.completion": "", "tool.output.result": "out", "tool.type": "search"}), ("t", "b", "1", {"llm.prompts": "p", "llm.provider": "x"}), ("t", "c", "0", {"tool.input.a": "1", "tool.input.b": "2"}), ("u", "d", None, None)]
    df = spark.createDataFrame([(*s[:3], "ok", s[3]) for s in spans], "trace_id string, span_id string, start_time string, status string, attributes map<string, string>")
    got = {r["turn_id"]: r for r in agents.span_turns(df).collect()}
    assert (got["a"]["agent_response"], got["a"]["agent_role"], got["a"]["agent_task"]) == ("out", "search", "q")
    assert got["b"]["agent_task"] == "p" and got["c"]["agent_task"] is None and len(got["c"]["ambiguous_input"]) == 2
    assert [got[i]["agent_exit"] for i in "abcd"] == [False, True, False, True]


def test_trajectories(spark):
    df = spark.createDataFrame([("i", "m", "1", [("user", None, "a", True), None, ("ai", "s", "b", False)], "done", "p", "log")], "instance_id string, model_name string, target string, trajectory array<struct<role: string, system_prompt: string, text: string, mask: boolean>>, exit_status string, generated_patch string, eval_logs string")
    assert [(r["agent_response"], r["agent_exit"]) for r in agents.trajectory_turns(df).collect()] == [("a", False), ("b", True)]


def test_conversations(spark):
    turns = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(["user", "assistant", "user", "other"])] + [(2, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    w = {(r["conv_id"], r["turn"]): [x["turn"] for x in r["window"]] for r in conversation.context_window(turns, 2).collect()}
    assert w[1, 3] == [1, 2] and w[1, 0] == [] and w[2, 0] == []
    k = {r["turn"]: [x["turn"] for x in r["window"]] for r in conversation.context_window(turns, 2, current=True, role="user").where("conv_id = 1").collect()}
    assert k[2] == [0, 2] and k[3] == [2]
    assert conversation.by_role(turns).where("conv_id = 1").first()["user_text"] == "t0\nt2"


def test_generate_sends_each_prompt_once(spark, tmp_path):
    log = tmp_path / "calls"

    def call(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise KeyError(prompt)
        return prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "id int, prompt string")
    out = judging.generate(df, call, errors="empty")
    assert {r["id"]: r["response"] for r in out.collect()} == {1: "A", 2: "A", 3: "", 4: ""}
    assert sorted(log.read_text().split()) == ["a", "bad"]
    with pytest.raises(Exception, match="KeyError"):
        judging.generate(df, call).collect()


def test_panel_results(spark):
    judges = judging.panel_of(spark, "experts", ["x", "y"])
    judged = spark.createDataFrame([("s", "x", '{"score": 5, "reasoning": "r"}'), ("s", "y", '{"score": 1, "reasoning": "r"}')], "sample_id string, judge string, response string")
    row = judging.panel_results(judged, judges).first()
    assert round(row["weighted_mean"], 6) == round(2 / 3, 6)
    assert judging.panel_results(judged, judges, require_consensus=0.5).first()["mean"] == 0.0


def test_stage_metrics(spark):
    rows = [("s", "retrieval", 5.0, True), ("s", "generation", 1500.0, False), ("s", "x", 100.0, True)]
    r = stages.stage_metrics(spark.createDataFrame(rows, "sample_id string, stage_name string, latency_ms double, success boolean")).first()
    assert round(r["isolation"], 6) == round(2 / 3, 6) and r["recovery"] == 0.5 and r["latency_score"] == 0.7


def test_choose_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    pick = lambda d: sorted(r["k"] for r in samples.choose(d, 17, 5, "k").collect())
    assert pick(df.repartition(1)) == pick(df.repartition(13)) and len(pick(df)) == 17
    assert samples.choose(df, 0, id_col="k").count() == 0 and samples.choose(df, None).count() == 1000


def test_version_diff(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "item_key string, v string")
    b = spark.createDataFrame([("1", "x"), ("2", "z"), ("4", "w")], "item_key string, v string")
    assert {tuple(r) for r in samples.version_diff(a, b).collect()} == {("2", "changed"), ("3", "removed"), ("4", "added")}


def test_canonical_and_subjects(spark):
    df = spark.createDataFrame([("q", "a", "keep"), (None, "a", "x"), ("q", None, "x")], "input string, expected string, extra string")
    out = samples.canonical(df)
    assert out.columns == ["id", "input", "expected", "original_extra"] and out.count() == 1 and out.first()["id"].startswith("custom_")
    with pytest.raises(ValueError):
        samples.only_subjects(df, ["nope"], ["yes"])
    with pytest.raises(ValueError):
        samples.validate(df, ["gone"])


def test_without_columns_at_any_depth(spark):
    df = spark.createDataFrame([(1, (2, (3, 4)), [(5, 6)])], "a int, b struct<a: int, c: struct<a: int, d: int>>, e array<struct<a: int, f: int>>")
    out = samples.without_columns(df, ["a"])
    assert out.schema.simpleString() == "struct<b:struct<c:struct<d:int>>,e:array<struct<f:int>>>"


def test_difference_of_runs(spark):
    old = spark.createDataFrame([("1", 1.0), ("2", 0.0), ("3", None)], "sample_id string, score double")
    new = spark.createDataFrame([("1", 1.0), ("2", 1.0), ("4", 0.5)], "sample_id string, score double")
    assert {(r["sample_id"], r["difference"]) for r in aggregates.score_diff(old, new).collect()} == {("2", 1.0), ("4", 0.5)}


def test_bins_and_ranks(spark):
    df = spark.createDataFrame([(float(x), float(x)) for x in (0, 5, 10, 10)], "x double, y double")
    assert {r["bin"]: r["n"] for r in aggregates.equal_width_bins(df, "x", "y").collect()} == {1: 1, 5: 1, 10: 2}
    assert sorted(r["r"] for r in aggregates.average_ranks(df, "x", "r").collect()) == [1.0, 2.0, 3.5, 3.5]
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert aggregates.correlations(same, "x", "y").first()["pearson"] is None


def test_exact_percentiles_of_many_values(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": rng.choice(["a", "b"], 30_000, p=[0.9, 0.1]), "v": np.concatenate([rng.normal(0, 1, 15_000), np.round(rng.exponential(5, 15_000))])})
    df = spark.createDataFrame(pd.concat([frame, pd.DataFrame({"k": ["one"], "v": [4.0]})]))
    got = {(r["k"], r["q"]): r["value"] for r in requests.exact_percentiles(df, "k", "v", (0.0, 0.5, 0.95, 1.0), 1000).collect()}
    for k, xs in [*((k, g["v"]) for k, g in frame.groupby("k")), ("one", [4.0])]:
        for q in (0.0, 0.5, 0.95, 1.0):
            assert abs(got[k, q] - np.percentile(xs, q * 100)) < 1e-9, (k, q)


def test_upsert_and_lookups(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    changes = spark.createDataFrame([(2, "c", None), (3, "x", True), (4, "d", False)], "k int, v string, _deleted boolean")
    assert {tuple(r) for r in samples.upsert(current, changes, ["k"]).collect()} == {(1, "a"), (2, "c"), (4, "d")}
    scores = spark.createDataFrame([(1, 0.5), (1, 0.7)], "k int, score double")
    assert {(r["k"], r["score"]) for r in samples.with_scores(current, scores, "k").collect()} == {(1, 0.7), (2, 0.0), (3, 0.0)}
    with pytest.raises(ValueError):
        samples.search_items(current, version="1.2")


def test_evaluate_turns(spark):
    df = spark.createDataFrame([("u", "t", "1", "a", "do", "role", "sys", "resp", "true", '{"score": 4, "reasoning": "r"}'), ("u", "t", "2", "a", None, "role", "sys", "resp", "no", "5")],
        "user_id string, task_id string, turn_id string, agent_name string, agent_task string, agent_role string, system_prompt string, agent_response string, agent_exit string, r string")
    typed = agents.typed_turns(df).join(df.select("turn_id", "r"), "turn_id")
    got = {r["turn_id"]: (r["task_progression"], r["task_progression_valid"]) for r in agents.evaluate_turns(typed, {"task_progression": "r"}).collect()}
    assert got == {"1": (4.0, True), "2": (0.0, False)}


def test_small_side_measures(spark):
    from assaykit.session import small_side

    wide = spark.createDataFrame([("x" * 1000,)] * 50, "s string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small_side(wide)) and not hinted(small_side(wide, size=10_000)) and not hinted(small_side(wide, rows=10))


def test_judging_from_prompts_to_scores(spark):
    from assaykit.operators import prompts

    assert set(prompts.PROMPTS) == set(generation.SCORERS) and set(prompts.AGENT_PROMPTS) == set(agents.SCORERS)
    assert set(prompts.ITEMS) == {n for n, s in generation.SCORERS.items() if s.per_item}

    def call(prompt):
        if "the claim" in prompt:
            return "Rating: 5" if "first claim" in prompt else "Rating: 1"
        return '{"bias_score": 2}' if "biased" in prompt else "Rating: 4"

    df = spark.createDataFrame([("a", "q", "The first claim here. The second claim here.", "one\n\ntwo"), ("b", "q", "", "one"), ("c", "q", "The first claim here.", None)], "sample_id string, question string, output string, context string")
    names = ["bias_detection", "clarity_and_coherence", "context_faithfulness", "conflict_resolution"]
    got = {r["sample_id"]: tuple(round(r[n], 6) for n in names) for r in prompts.judge_answers(df, names, call).collect()}
    assert got == {"a": (0.8, 0.8, 0.6, 0.8), "b": (0.0, 0.0, 0.0, 0.0), "c": (0.8, 0.8, 0.0, 0.0)}
    recorded = prompts.answer_prompts(df, names, "sample_id", "question", "output", "context").select("prompt", F.lit("Rating: 3").alias("response"))
    assert prompts.judge_answers(df, names, recorded=recorded).where("sample_id = 'a'").first()["clarity_and_coherence"] == 0.6
    assert df.select(prompts.escaped(F.lit("a {b}"))).first()[0] == "a {{b}}"
