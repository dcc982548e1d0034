"""Queries that run every scorer of judged answers, agents and conversations, with all their branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import responses, text
from assaykit.operators import agents, aggregates, conversation, generation, requests, retrieval, samples, stages
from assaykit.plans.registry import Registry, r6, rounded, table
from assaykit.plans.texts import st

REGISTRY = Registry()

# --- generated answers ---------------------------------------------------------------------------------

_FIELDS = ("bias_score", "accuracy_score", "verification_score")
_ANSWERS = f"""a as (select doc_id, text as output, case doc_id % 4 when 1 then 'one' when 2 then 'first' || chr(10) || chr(10) || 'second' when 3 then ' ' end as context,
  case doc_id % 5 when 0 then 'Rating: ' || (doc_id % 4 + 1) when 1 then 'I would give ' || (doc_id % 4 + 1) || ' of 5' when 2 then 'no number'
    when 3 then 'so: {{{", ".join(f'"{f}": ' + "' || (doc_id % 4 + 1) || '" for f in _FIELDS)}}} 9' else '{{"other": 2}}' end as response,
  list_transform(range(0, (doc_id % 4)::bigint), lambda i: case (doc_id + i) % 3 when 0 then 'Rating: ' || ((doc_id + i) % 5 + 1) when 1 then '{{"verification_score": ' || (i + 1) || '}}' else 'none' end) as items from documents)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    n = (i % 4 + 1).cast("string")
    fields = [x for k, f in enumerate(_FIELDS) for x in (F.lit((", " if k else "") + f'"{f}": '), n)]
    response = (
        F.when(i % 5 == 0, F.concat(F.lit("Rating: "), n)).when(i % 5 == 1, F.concat(F.lit("I would give "), n, F.lit(" of 5"))).when(i % 5 == 2, "no number")
        .when(i % 5 == 3, F.concat(F.lit("so: {"), *fields, F.lit("} 9"))).otherwise('{"other": 2}')
    )
    item = lambda k: F.when((i + k) % 3 == 0, F.concat(F.lit("Rating: "), ((i + k) % 5 + 1).cast("string"))).when(
        (i + k) % 3 == 1, F.concat(F.lit('{"verification_score": '), (k + 1).cast("string"), F.lit("}"))
    ).otherwise("none")
    items = F.when(i % 4 > 0, F.transform(F.sequence(F.lit(0), (i % 4 - 1).cast("int")), item)).otherwise(F.array().cast("array<string>"))
    context = F.when(i % 4 == 1, "one").when(i % 4 == 2, "first\n\nsecond").when(i % 4 == 3, " ")
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("output"), context.alias("context"), response.alias("response"), items.alias("items"))


def _settings() -> str:
    rows = []
    for name, s in generation.SCORERS.items():
        kind, _, field = s.parse.partition(":")
        rows.append(f"('{name}', {s.threshold}, '{field}', {s.default}, {str(s.inverted).lower()}, {str('context' in s.needs).lower()}, {s.chunks}, {str(s.per_item).lower()})")
    return f"g(scorer, threshold, field, fallback, inverted, wants, chunks, each) as (values {', '.join(rows)})"


def _number(x: str) -> str:
    """SQL of the number that a response gives to the scorer of row g."""
    last = f"try_cast(regexp_extract_all({x}, '\\b(\\d+)\\b', 1)[-1] as double)"
    named = f"try_cast(nullif(regexp_extract({x}, 'Rating:\\s*(\\d+)', 1), '') as double)"
    braces = f"regexp_extract({x}, '(?s)\\{{.*\\}}', 0)"
    return f"""case when field = '' then coalesce({named}, {last}, fallback) when {braces} <> '' and json_valid({braces})
      then coalesce(try_cast(json_extract_string({braces}, '$.' || field) as double), fallback) else coalesce({last}, fallback) end"""


@REGISTRY.add(f"""with {_ANSWERS}, {_settings()}, x as (select *, {_number('response')} as one, list_transform(items, lambda r: {_number('r')}) as many from a, g),
  y as (select *, case when coalesce({st('output')}, '') = '' then 0.0 when wants and coalesce({st('context')}, '') = '' then 0.0
    when chunks > 0 and len(list_filter(string_split(context, chr(10) || chr(10)), lambda p: {st('p')} <> '')) < chunks then 1.0 when each and len(many) = 0 then 1.0
    when each then list_avg(list_transform(many, lambda v: case when inverted then (6 - v) / 5 else v / 5 end)) when inverted then (6 - one) / 5 else one / 5 end::double as s from x)
  select doc_id, scorer, round(s, 6) as score, s >= threshold as passed from y""")
def g1_g21_all_scorers(spark: SparkSession, d: str) -> DataFrame:
    names = {n: "items" if s.per_item else "response" for n, s in generation.SCORERS.items()}
    scored = generation.with_scores(_answers(spark, d), names, "output", "context")
    each = F.array(*[F.struct(F.lit(n).alias("scorer"), r6(n).alias("score"), F.col(f"{n}_passed").alias("passed")) for n in names])
    return scored.select("doc_id", F.inline(each))


_VERDICTS = """list_transform(range(0, (doc_id % 5)::bigint), lambda i: case (doc_id + i) % 4 when 0 then 'PRESENT' when 1 then 'partially_present' when 2 then 'NOT_PRESENT' else 'unclear' end)"""


@REGISTRY.add(f"""with d as (select doc_id, text, {_VERDICTS} as v, list_transform(range(0, (doc_id % 3)::bigint), lambda i: case when (doc_id + i) % 2 = 0 then 'Rating: ' || (i + 2) else 'maybe 4 or 5' end) as r,
    case when doc_id % 6 = 0 then ' ' else 'known' end as expected, case when doc_id % 7 = 0 then null else 'context' end as context from documents),
  s as (select *, case when coalesce({st('context')}, '') = '' or {st('expected')} = '' or len(v) = 0 then 0.0 else list_avg(list_transform(v, lambda x: case when contains(upper(x), 'PARTIALLY_PRESENT') then 0.5 when contains(upper(x), 'NOT_PRESENT') then 0.0 when contains(upper(x), 'PRESENT') then 1.0 else 0.0 end)) end as recall,
    case when len(r) = 0 then 0.0 else list_avg(list_transform(r, lambda x: coalesce(try_cast(nullif(regexp_extract(x, 'Rating:\\s*(\\d+)', 1), '') as double), try_cast(regexp_extract_all(x, '\\b([1-5])\\b', 1)[1] as double), 3.0) / 5)) end as prec from d)
  select doc_id, round(recall, 6)::double as contextual_recall, round(prec, 6)::double as contextual_precision, round(0.2 * recall + 0.2 * prec + 0.25 * 0.5 + 0.35 * 0.25, 6)::double as ragas from s""")
def l3_l5_context_scores(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    verdict = lambda k: F.when((i + k) % 4 == 0, "PRESENT").when((i + k) % 4 == 1, "partially_present").when((i + k) % 4 == 2, "NOT_PRESENT").otherwise("unclear")
    rating = lambda k: F.when((i + k) % 2 == 0, F.concat(F.lit("Rating: "), (k + 2).cast("string"))).otherwise("maybe 4 or 5")
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), f)).otherwise(F.array().cast("array<string>"))
    recall = generation.contextual_recall(upto(i % 5, verdict), F.when(i % 7 != 0, "context"), F.when(i % 6 == 0, " ").otherwise("known"))
    rows = table(spark, d, "documents").select("doc_id", recall.alias("contextual_recall"), generation.contextual_precision(upto(i % 3, rating)).alias("contextual_precision"))
    parts = {"contextual_recall": F.col("contextual_recall"), "contextual_precision": F.col("contextual_precision"), "faithfulness": F.lit(0.5), "answer_relevancy": F.lit(0.25)}
    return rounded(rows.withColumn("ragas", stages.weighted(parts, generation.RAGAS_WEIGHTS)))


# --- agents --------------------------------------------------------------------------------------------


_AGENT_FIELDS = sorted({f for _, needs, _, _ in agents.SCORERS.values() for f in needs})
_NEEDS = "g(scorer, needs, gated, per_call) as (values " + ", ".join(f"('{n}', [{', '.join(repr(f) for f in needs)}], {str(gated).lower()}, {str(per_call).lower()})" for n, (_, needs, gated, per_call) in agents.SCORERS.items()) + ")"


@REGISTRY.add(f"""with {_NEEDS}, t as (select row_id, lower(trim(agent_exit)) in ('true', '1', 'yes', 'on') as exited, list_filter([{', '.join(f"case when {f} is null then '{f}' end" for f in _AGENT_FIELDS)}], lambda x: x is not null) as gone from simple_agent_dataset),
  m as (select *, list_filter(needs, lambda n: list_contains(gone, n)) as missing from t, g),
  s as (select *, case when len(missing) > 0 then 0.0 when gated and not coalesce(exited, false) then -1.0 when per_call then case row_id % 3 when 0 then (row_id % 10 + 1)::double when 1 then 0.0 else 8.5 end else case row_id % 4 when 0 then 7.0 when 1 then 1.0 when 2 then 3.5 else 4.0 end end::double as score from m)
  select row_id, scorer, score, len(missing) = 0 and score >= 0 as valid, array_to_string(missing, ',') as missing from s""")
def ag1_ag8_all_scorers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("row_id")
    t = table(spark, d, "simple_agent_dataset")
    first = F.concat(F.lit('Here: {"score": '), (i % 10 + 1).cast("string"), F.lit(', "reasoning": "r"}'))
    calls = F.when(i % 3 == 0, F.array(first, F.lit('{"score": 2}'))).when(i % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit('"score": 8.5, reasoning: none'), F.lit("x")))
    once = F.when(i % 4 == 0, "score: 7").when(i % 4 == 1, "nothing to say").when(i % 4 == 2, '{"score": 3.5}').otherwise("it is 4 of 5")
    present, exited = {f: F.col(f) for f in _AGENT_FIELDS}, text.truthy(F.col("agent_exit"))
    scored = [agents.agent_score(n, calls if per_call else once, present, exited).alias(n) for n, (_, _, _, per_call) in agents.SCORERS.items()]
    rows = t.select("row_id", *scored)
    each = F.array(*[F.struct(F.lit(n).alias("scorer"), F.col(f"{n}.score").alias("score"), F.col(f"{n}.valid").alias("valid"), F.array_join(f"{n}.missing", ",").alias("missing")) for n in agents.SCORERS])
    return rows.select("row_id", F.inline(each))


_SPAN = """s as (select delivery_id::varchar || '/' || trace_id as task_id, unnest(spans) as s from sample_traces),
  f as (select task_id, s.span_id as turn_id, s.status as exit_status, s.attributes as a from s where s.span_id is not null),
  i as (select *, list_filter(map_entries(a), lambda e: (starts_with(e.key, 'agent.input.') and e.key <> 'agent.input.topic') or starts_with(e.key, 'tool.input.')) as inputs from f)"""


def _attribute(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(a['{k}'], '')" for k in keys) + ")"


@REGISTRY.add(f"""with {_SPAN}, o as (select task_id, turn_id, exit_status, {_attribute('agent.output.result', 'tool.output.result', 'llm.completion')} as agent_response, coalesce({_attribute('agent.type', 'tool.type', 'llm.provider')}, '') as agent_role,
    case when len(inputs) = 1 then inputs[1].value when coalesce(len(inputs), 0) = 0 then {_attribute('llm.prompts')} end as agent_task, coalesce(len(inputs), 0) > 1 as ambiguous from i)
  select task_id, turn_id, coalesce(exit_status, '') as exit_status, coalesce(agent_response, '') as agent_response, agent_role, coalesce(agent_task, '') as agent_task, ambiguous, count(*) as n from o group by all""")
def p9_p11_span_turns(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "sample_traces").select(F.concat(F.col("delivery_id").cast("string"), F.lit("/"), F.col("trace_id")).alias("trace_id"), F.inline("spans").alias(
        "span_id", "t", "parent_span_id", "name", "start_time", "end_time", "duration_ms", "status", "status_message", "attributes")).where("span_id is not null")
    turns = agents.span_turns(spans.drop("t"))
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("exit_status", "agent_response", "agent_role", "agent_task")]
    return turns.select("task_id", "turn_id", *keys, F.col("ambiguous_input").isNotNull().alias("ambiguous")).groupBy("task_id", "turn_id", "exit_status", "agent_response", "agent_role", "agent_task", "ambiguous").agg(F.count(F.lit(1)).alias("n"))


# --- conversations -------------------------------------------------------------------------------------


@REGISTRY.add(f"""with t as (select user_id as conv_id, event_id as turn, case event_type when 'click' then 'user' when 'view' then 'assistant' else 'other' end as role, props as text from events),
  w as (select *, list({{'turn': turn, 'role': role}}) over (partition by conv_id order by turn rows between 5 preceding and 1 preceding) as before, list({{'turn': turn, 'role': role}}) over (partition by conv_id order by turn rows between 10 preceding and current row) as upto from t)
  select conv_id, turn, case when {st('text')} = '' then 0.0 when coalesce(len(before), 0) > 0 then case turn % 3 when 0 then 0.8 when 1 then 0.6 else 0.2 end else 0.0 end::double as relevancy, len(list_filter(upto, lambda x: x.role = 'user'))::int as known,
    coalesce(list_min(list_transform(list_filter(upto, lambda x: x.role = 'user'), lambda x: x.turn)), -1) as first_known from w where text is not null""")
def c2_w4_windows(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "assistant").otherwise("other")
    turns = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), F.col("props").alias("text"))
    rows = conversation.context_window(conversation.context_window(turns, 5), 10, current=True, role="user", out="known")
    response = F.when(F.col("turn") % 3 == 0, "I say 4, not 9").when(F.col("turn") % 3 == 1, "no number").otherwise("1 of 5")
    first = F.coalesce(F.array_min(F.transform("known", lambda x: x["turn"])), F.lit(-1))
    return rows.where("text is not null").select("conv_id", "turn", conversation.relevancy(F.col("text"), F.col("window"), response).alias("relevancy"), F.size("known").alias("known"), first.alias("first_known"))


@REGISTRY.add("""with i as (select doc_id, case doc_id % 4 when 0 then 'none' when 1 then '1. find it' || chr(10) || '2) fix it' when 2 then 'talk' else '3. ask' end as goals, doc_id % 5 <> 0 as spoke from documents)
  select doc_id, case doc_id % 4 when 1 then 2 when 3 then 1 else 0 end::int as intentions, case when not spoke then 0.0 when doc_id % 4 in (0, 2) then 1.0 else 0.7 end::double as completeness,
    case when doc_id % 3 = 0 then 0.2 when not spoke then 0.4 else 0.7 end::double as heuristic from i""")
def c3_t23_completeness(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    goals = F.when(i % 4 == 0, "none").when(i % 4 == 1, "1. find it\n2) fix it").when(i % 4 == 2, "talk").otherwise("3. ask")
    ratings = F.array(F.lit("I rate it 4"), F.lit("3 of 5"))
    answer = F.when(i % 3 == 0, "short").when(i % 5 == 0, "I am sorry, I can't tell").otherwise("a long enough answer")
    return table(spark, d, "documents").select(
        "doc_id", F.size(text.numbered_items(goals)).alias("intentions"), r6(conversation.completeness(goals, ratings, i % 5 != 0)).alias("completeness"), text.completeness_heuristic(answer).alias("heuristic")
    )


# --- names, flags and filters --------------------------------------------------------------------------


@REGISTRY.add("""with r as (select event_id, case event_id % 4 when 0 then 'large-32k' when 1 then 'small-8k' when 2 then 'mid-64k' else 'plain' end as model, case event_id % 3 when 0 then 'acme' when 1 then '' end as provider from events)
  select case event_id % 4 when 0 then 'large' when 1 then 'small' when 2 then 'mid-64k' else 'plain' end as model, count(*) as n from r where provider = 'acme' group by 1""")
def f4_m7_models(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    model = F.when(i % 4 == 0, "large-32k").when(i % 4 == 1, "small-8k").when(i % 4 == 2, "mid-64k").otherwise("plain")
    rows = table(spark, d, "events").select(model.alias("model"), F.when(i % 3 == 0, "acme").when(i % 3 == 1, "").alias("provider"))
    return requests.only(rows, provider="acme", model="").groupBy(requests.plain_model_name(F.col("model")).alias("model")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("""with r as (select l_suppkey as run, case when l_linenumber = 1 then 'MEAN' else l_orderkey || '_' || l_linenumber end as sample_id, l_discount as score from lineitem)
  select run, count(score) as n, round(avg(score), 6) as accuracy from r where sample_id <> 'MEAN' group by run""")
def f9_without_means(spark: SparkSession, d: str) -> DataFrame:
    sample = F.when(F.col("l_linenumber") == 1, "MEAN").otherwise(F.concat_ws("_", "l_orderkey", "l_linenumber"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), sample.alias("sample_id"), F.col("l_discount").alias("score"), F.lit(1.0).alias("tokens"), F.lit(1.0).alias("cost"))
    return aggregates.run_performance(rows, ["run"]).select("run", "n", r6("accuracy").alias("accuracy"))


@REGISTRY.add("""select item_id, case when contains(subset || '_' || item_id, '_') then regexp_replace(subset || '_' || item_id, '_[^_]*$', '') else 'unknown' end as subset, case when item_id % 2 = 0 then 'unknown' else subset end as maybe from eval_items""")
def p18_subsets(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat_ws("_", "subset", F.col("item_id").cast("string"))
    return table(spark, d, "eval_items").select("item_id", text.subset_of(named).alias("subset"), text.subset_of(F.when(F.col("item_id") % 2 == 0, "plain").otherwise(named)).alias("maybe"))


@REGISTRY.add("""select doc_id, doc_id % 6 in (0, 2, 3) as relevant, case doc_id % 3 when 0 then 0.4 when 1 then 0.7 else 0.0 end::double as metric, case when doc_id % 5 = 0 then 'top' when doc_id % 5 = 1 then 'high' when doc_id % 5 = 2 then 'fair' when doc_id % 5 = 3 then 'low' else 'none' end as label,
  case when doc_id % 4 = 0 then 0.0 else round(1.0 / (doc_id % 4), 6) end::double as share from documents""")
def r11_r13_flags(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    response = F.when(i % 6 == 0, 'so {"relevant": true}').when(i % 6 == 1, '{"relevant": false}').when(i % 6 == 2, "Yes it is").when(i % 6 == 3, "rated 1").when(i % 6 == 4, "not at all").otherwise('{"x": 1}')
    result = F.when(i % 3 == 0, F.create_map(F.lit("f1"), F.lit(0.9), F.lit("average"), F.lit(0.4))).when(i % 3 == 1, F.create_map(F.lit("recall"), F.lit(0.7))).otherwise(F.create_map(F.lit("other"), F.lit(0.3)))
    score = F.when(i % 5 == 0, 0.9).when(i % 5 == 1, 0.75).when(i % 5 == 2, 0.5).when(i % 5 == 3, 0.3).otherwise(0.1)
    same = F.when(i % 4 > 0, F.transform(F.sequence(F.lit(1), (i % 4).cast("int")), lambda _: F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select(
        "doc_id", responses.relevance_flag(response).alias("relevant"), retrieval.main_metric(result).alias("metric"), text.band(score, ("top", "high", "fair", "low", "none")).alias("label"), r6(text.distinct_share(same)).alias("share")
    )


@REGISTRY.add("""with p as (select doc_id, (doc_id % 5) / 5.0 as a, (doc_id % 7) / 7.0 as b from documents), s as (select *, 0.25 * a + 0.25 * b + 0.2 * a + 0.15 * b + 0.1 * a + 0.05 * b as r, (0.15 + 0.12 + 0.10 + 0.08 + 0.06 + 0.04) * a + (0.12 + 0.10 + 0.08 + 0.06 + 0.05 + 0.04) * b as g from p)
  select doc_id, round(r, 6)::double as retrieval, round(g, 6)::double as generation, round(r, 6) >= 0.6 as retrieved, round(g, 6) >= 0.6 as generated from s""")
def rp2_rp3_rp8_stages(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.col("doc_id") % 5) / 5.0, (F.col("doc_id") % 7) / 7.0
    alternate = lambda names: {n: (a, b)[k % 2] for k, n in enumerate(names)}
    found = stages.retrieval_stage(alternate(stages.RETRIEVAL_WEIGHTS))
    made = stages.generation_stage(alternate(stages.GENERATION_WEIGHTS))
    rows = table(spark, d, "documents").select("doc_id", r6(found).alias("retrieval"), r6(made).alias("generation"))
    return rows.select("*", stages.succeeded(F.col("retrieval")).alias("retrieved"), stages.succeeded(F.col("generation")).alias("generated"))


@REGISTRY.add("""select doc_id, case doc_id % 8 when 0 then 4.5 when 1 then 2.0 when 2 then 0.0 when 3 then 0.0 when 4 then 7.0 when 5 then 0.0 when 6 then 0.0 else 0.0 end::double as score,
  case doc_id % 8 when 0 then 'fine' when 1 then 'first' when 2 then 'Error: no model' else '' end as reasoning from documents""")
def ag11_result_forms(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 8
    result = (
        F.when(i == 0, '{"score": 4.5, "reasoning": "fine"}').when(i == 1, '[{"score": 2, "reasoning": "first"}, {"score": 9}]').when(i == 2, '{"error": "no model", "missing_fields": ["trace"]}')
        .when(i == 3, "[]").when(i == 4, "7").when(i == 5, '{"note": 1}').when(i == 6, "not a number")
    )
    return table(spark, d, "documents").select("doc_id", responses.result_score(result).alias("r")).select("doc_id", "r.score", "r.reasoning")


@REGISTRY.add("""select count(distinct l_returnflag) as total_models, count(distinct l_orderkey) as total_samples, count(distinct l_linestatus) as total_scorers, (select count(*) from events where event_type = 'click') as total_errors from lineitem""")
def a8_run_totals(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("sample_id"), F.col("l_linestatus").alias("scorer"))
    return aggregates.run_totals(long, table(spark, d, "events").where("event_type = 'click'"))


@REGISTRY.add("""select item_id::varchar as id, 'Here are some example questions from ' || array_to_string(list_transform(string_split(replace(subset, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ':' || chr(10) || chr(10) || 'Question: ' || question || chr(10)
  || array_to_string(list_transform(range(1, len(choices) + 1), lambda i: chr((64 + i)::int) || '. ' || choices[i] || chr(10)), '') || 'Answer:' as input from eval_items where question is not null and choices is not null""")
def pr3_few_shot_prompts(spark: SparkSession, d: str) -> DataFrame:
    return samples.choice_samples(table(spark, d, "eval_items"), few_shot=3).select("id", "input")


@REGISTRY.add("""select doc_id, 'precision: ' || case doc_id % 3 when 0 then '0.950 (excellent)' when 1 then '0.500 (fair)' else '0.100 (very poor)' end || chr(10) || 'recall: 0.000 (very poor)' as reasoning from documents""")
def t25_combined_reasoning(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("doc_id") % 3 == 0, 0.95).when(F.col("doc_id") % 3 == 1, 0.5).otherwise(0.1)
    return table(spark, d, "documents").select("doc_id", text.combined_reasoning({"precision": score, "recall": F.lit(None).cast("double")}).alias("reasoning"))


@REGISTRY.add("""select r_regionkey::varchar as key, r_name as name, '' as region from region union all select n_nationkey::varchar, n_name, n_regionkey::varchar from nation""")
def x7_ragged_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return samples.union_all([a, b], fill="")
