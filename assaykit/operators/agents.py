"""Agent turns: typed fields, calls with their results, scorers, and the rows they are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import responses
from assaykit.functions.text import paragraphs, strip, truthy

TOOL = "array<struct<name: string, description: string, args_schema: string, return_schema: string>>"
CALL = "struct<tool_name: string, parameters: string, call_id: string>"
RESULT = "struct<call_id: string, result: string, success: boolean, error_message: string>"

#: field -> type it is read as where its text looks like JSON.
TYPES = {
    "trace": "array<string>", "tools_available": TOOL, "tool_calls": f"array<{CALL}>", "parameters_passed": "map<string, string>",
    "tool_call_results": f"array<{RESULT}>", "retrieval_query": "array<string>", "retrieved_context": "array<array<string>>", "expected_tool_call": CALL,
}


def typed(c: Column, ddl: str) -> tuple[Column, Column]:
    """(value, raw): the JSON value where the trimmed text has the type's brackets and parses, else the text as it is; null gives neither."""
    s = strip(c)
    shape = r"(?s)^\[.*\]$" if ddl.startswith("array") else r"(?s)^\{.*\}$"
    value = F.when(s.rlike(shape) & responses.parsed(s).isNotNull(), F.from_json(s, ddl))
    return value, F.when(value.isNull(), c)


def typed_turns(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Agent turns with a typed column and a `_raw` column per JSON field, exactly one of them set unless the field is null.

    columns: field -> source column; fields without a source are null. agent_exit is true, false, or raw text.
    """
    source = columns or {}
    get = lambda f: F.col(f"`{source.get(f, f)}`") if source.get(f, f) in df.columns else F.lit(None).cast("string")
    plain = ("user_id", "task_id", "turn_id", "ground_truth", "agent_name", "agent_role", "agent_task", "system_prompt", "agent_response", "exit_status", "metadata")
    out = [get(f).cast("string").alias(f) for f in plain]
    for f, ddl in TYPES.items():
        value, raw = typed(get(f).cast("string"), ddl)
        out += [value.alias(f), raw.alias(f"{f}_raw")]
    flag = truthy(get("agent_exit").cast("string"))
    out += [flag.alias("agent_exit"), F.when(flag.isNull(), get("agent_exit").cast("string")).alias("agent_exit_raw")]
    return df.select(*out)


def retrieval_mismatch(queries: Column, contexts: Column) -> Column:
    """True where both are lists and differ in length."""
    return F.coalesce(F.size(queries) != F.size(contexts), F.lit(False))


def missing_fields(**fields: Column) -> Column:
    """Names of the fields that are null, in order."""
    return F.filter(F.array(*[F.when(c.isNull(), name) for name, c in fields.items()]), lambda x: x.isNotNull())


def calls_with_results(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, tool_name, parameters, call_id, result, success): each call with the last result of its call_id, if any.

    Calls and results of a turn stand in one row, so the join is within the row.
    """
    calls = df.select(*keys, "tool_call_results", F.posexplode("tool_calls").alias("pos", "c"))
    last = F.try_element_at(F.filter("tool_call_results", lambda r: r["call_id"] == F.col("c.call_id")), F.lit(-1))
    return calls.withColumn("r", last).select(*keys, "pos", "c.tool_name", "c.parameters", "c.call_id", "r.result", "r.success")


#: scorer -> (top of its scale, fields it needs, whether the agent must have exited, one response per tool call)
SCORERS = {
    "tool_relevancy": (10, ("tools_available", "tool_calls"), False, True),
    "tool_correctness": (10, ("expected_tool_call", "tool_calls"), False, True),
    "parameter_correctness": (10, ("tool_calls", "parameters_passed", "tool_call_results"), False, True),
    "task_progression": (5, ("agent_task", "agent_role", "system_prompt", "agent_response"), False, False),
    "context_relevancy": (10, ("agent_task", "agent_role", "agent_response"), False, False),
    "role_adherence": (10, ("agent_role", "agent_task", "agent_response", "tool_calls"), False, False),
    "goal_achievement": (10, ("trace",), True, False),
    "conversation_coherence": (10, ("trace",), True, False),
}


def agent_score(name: str, response: Column, present: dict[str, Column], exited: Column | None = None) -> Column:
    """STRUCT<score, valid, missing>. Missing fields give 0 and their names; an agent that has not exited gives -1.

    response: the judge's text; an array of them for scorers per call, of which the first counts. No response gives 0. Scores keep their scale.
    """
    _, needs, gated, per_call = SCORERS[name]
    missing = missing_fields(**{f: present[f] for f in needs})
    text = F.try_element_at(response, F.lit(1)) if per_call else response
    score = F.when(F.size(missing) > 0, 0.0)
    if gated and exited is not None:
        score = score.when(~F.coalesce(exited, F.lit(False)), -1.0)
    score = score.otherwise(F.coalesce(F.when(text.isNotNull(), responses.agent_score(text)["score"]), F.lit(0.0)))
    return F.struct(score.alias("score"), ((F.size(missing) == 0) & (score >= 0)).alias("valid"), missing.alias("missing"))


def trajectory_steps(df: DataFrame, steps: str = "trajectory") -> DataFrame:
    """Rows of df by step, with `pos` from 0 and agent_exit true for the last; null steps are no rows but keep their place."""
    out = df.select("*", F.posexplode(steps).alias("pos", "step")).withColumn("agent_exit", F.col("pos") == F.size(steps) - 1)
    return out.where("step is not null").drop(steps)


def trajectory_turns(df: DataFrame) -> DataFrame:
    """Agent turns of trajectory steps (instance_id, model_name, target, step<role, system_prompt, text>, exit_status, generated_patch, eval_logs)."""
    result = F.struct(F.col("instance_id").alias("call_id"), F.col("generated_patch").alias("result"), F.lit(True).alias("success"), F.col("eval_logs").alias("error_message"))
    return trajectory_steps(df).select(
        F.col("instance_id").alias("turn_id"), F.col("model_name").alias("agent_name"), F.col("target").cast("string").alias("agent_task"), F.col("step.role").alias("agent_role"),
        F.col("step.system_prompt").alias("system_prompt"), F.col("step.text").alias("agent_response"), F.array(result).alias("tool_call_results"),
        "exit_status", "agent_exit", F.to_json(F.struct("pos", "instance_id")).alias("metadata"),
    )


def _first(attributes: Column, *keys: str) -> Column:
    """The first attribute that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit("")) for k in keys])


def span_turns(spans: DataFrame) -> DataFrame:
    """Agent turns of spans (trace_id, span_id, start_time, status, attributes MAP): response, role and input by priority.

    The last span of a trace by start has agent_exit; of equal starts the one with the greater id. A span
    with several agent or tool inputs has them all in `ambiguous_input` and no agent_task.
    """
    a = F.col("attributes")
    inputs = F.map_filter(a, lambda k, _: (k.startswith("agent.input.") & (k != "agent.input.topic")) | k.startswith("tool.input."))
    one = F.try_element_at(F.map_values(inputs), F.lit(1))
    # An aggregate and a join instead of a window: a trace of very many spans is reduced where they are read.
    at = F.struct(F.coalesce("start_time", F.lit("")).alias("s"), F.col("span_id").alias("i"))
    last_of = spans.groupBy(F.coalesce("trace_id", F.lit("")).alias("_t")).agg(F.max(at).alias("_last"))
    spans = spans.join(last_of, F.coalesce("trace_id", F.lit("")) == F.col("_t"))
    last = at == F.col("_last")
    return spans.select(
        F.col("trace_id").alias("task_id"), F.col("span_id").alias("turn_id"), _first(a, "agent.output.result", "tool.output.result", "llm.completion").alias("agent_response"),
        F.coalesce(_first(a, "agent.type", "tool.type", "llm.provider"), F.lit("")).alias("agent_role"),
        F.when(F.size(inputs) == 1, one).when(F.size(inputs) == 0, _first(a, "llm.prompts")).alias("agent_task"), F.when(F.size(inputs) > 1, inputs).alias("ambiguous_input"),
        F.col("status").alias("exit_status"), last.alias("agent_exit"), F.to_json(F.coalesce(a, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("metadata"),
    )


def rag_samples(df: DataFrame, query: str, answer: str, truth: str, context: str) -> DataFrame:
    """(query, ground_truth, generated_answer, retrieved_contexts): contexts are the paragraphs of a text, ranked by place."""
    items = F.transform(paragraphs(F.col(context)), lambda c, i: F.struct(c.alias("content"), F.lit(0.8).alias("relevance_score"), i.alias("rank")))
    return df.select(F.col(query).alias("query"), F.col(truth).alias("ground_truth"), F.col(answer).alias("generated_answer"), F.coalesce(items, F.array()).alias("retrieved_contexts"))


def serialized(typed_value: Column, raw: Column) -> Column:
    """A union field as text: as it came, else the JSON of its value, else ''."""
    return F.coalesce(raw, F.to_json(typed_value), F.lit(""))


def evaluate_turns(df: DataFrame, responses_: dict[str, str]) -> DataFrame:
    """(user_id, task_id, turn_id, agent_name, <scorer>, <scorer>_valid): every scorer -> response column of typed turns, in one projection."""
    fields = {f for name in responses_ for f in SCORERS[name][1]}
    present = {f: F.coalesce(F.col(f).cast("string"), F.col(f"{f}_raw")) if f"{f}_raw" in df.columns else F.col(f) for f in fields}
    scored = [agent_score(name, F.col(column), present, F.col("agent_exit")).alias(f"_{name}") for name, column in responses_.items()]
    rows = df.select("user_id", "task_id", "turn_id", "agent_name", *scored)
    return rows.select("user_id", "task_id", "turn_id", "agent_name", *[x for name in responses_ for x in (F.col(f"_{name}.score").alias(name), F.col(f"_{name}.valid").alias(f"{name}_valid"))])
