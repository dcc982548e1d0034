"""Queries of retrieval scorers, agent turns, spans and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions import text, vectors
from assaykit.operators import agents, conversation, retrieval, samples
from assaykit.plans.registry import Registry, r6, rounded, table

REGISTRY = Registry()

# --- retrieval -----------------------------------------------------------------------------------------

_RANKED = """with l as (select o_custkey as query_id, o_orderkey, (row_number() over (partition by o_custkey order by o_totalprice, o_orderkey))::int as pos, (o_orderkey % 2)::double as rel from orders),
  q as (select query_id, pos, 1 + (pos * 3) % 7 as rank, rel, case when 1 + (pos * 3) % 7 <= 5 then (6 - (1 + (pos * 3) % 7)) / 5.0 else 0.0 end as score from l)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), pos.alias("pos"), (F.col("o_orderkey") % 2).cast("double").alias("rel"))
    items = F.sort_array(F.collect_list(F.struct("pos", "rel")))
    lists = rows.groupBy("query_id").agg(items.alias("i"))
    return lists.select("query_id", F.transform("i", lambda x: (1 + (x["pos"] * 3) % 7).cast("int")).alias("rankings"), F.transform("i", lambda x: x["rel"]).alias("relevance"))


@REGISTRY.add(f"""{_RANKED},
  b as (select q.*, (select count(*) from q x where x.query_id = q.query_id and x.score > q.score) as before, (select count(*) from q x where x.query_id = q.query_id and x.score = q.score) as same from q),
  g as (select query_id, sum(rel * (select sum(1 / log2(i + 1)) from range(before + 1, before + same + 1) r(i)) / same) as gain from b group by query_id),
  o as (select query_id, sum(rel / log2(k + 1)) as best from (select query_id, rel, row_number() over (partition by query_id order by rel desc) as k from q) group by query_id),
  m as (select query_id, score, sum(rel) as hits, count(*) as n from q group by query_id, score),
  c as (select query_id, hits, sum(hits) over (partition by query_id order by score desc) as h, sum(n) over (partition by query_id order by score desc) as k, sum(hits) over (partition by query_id) as total from m),
  a as (select query_id, case when max(total) > 0 then sum(hits / total * h / k) else 0 end as ap from c group by query_id),
  r as (select query_id, coalesce(1.0 / min(case when rel > 0 then rank end), 0) as mrr, avg(score) as av, count(*) as n from q group by query_id)
  select r.query_id, round(mrr, 6)::double as mrr, round(case when n > 1 and best > 0 then gain / best else 0 end, 6)::double as ndcg, round(ap, 6)::double as map, round(av, 6)::double as avg_ranking,
    round((mrr::double + case when n > 1 and best > 0 then gain / best else 0 end + ap + av::double) / 4, 6)::double as combined from r join g using (query_id) join o using (query_id) join a using (query_id)""")
def r4_r8_ranking(spark: SparkSession, d: str) -> DataFrame:
    out = _ranked(spark, d).select("query_id", retrieval.ranking_scores(F.col("rankings"), F.col("relevance")).alias("s"))
    return rounded(out.select("query_id", "s.*"))


@REGISTRY.add("""with p as (select o_custkey as query_id, list((o_orderkey % 11)::double) as ratings, (count(*) + o_custkey % 3)::int as est from orders group by o_custkey),
  s as (select query_id, list_avg(list_transform(ratings, lambda x: case when x >= 7 then 1.0 else 0.0 end))::double as p, len(list_filter(ratings, lambda x: x >= 7)) / greatest(est, len(ratings))::double as r from p)
  select query_id, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6)::double as f1 from s""")
def r1_r3_chunk_relevance(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.collect_list((F.col("o_orderkey") % 11).cast("double")).alias("ratings"), (F.count(F.lit(1)) + F.col("o_custkey") % 3).alias("est"))
    p, r = retrieval.chunk_precision(F.col("ratings")), retrieval.chunk_recall(F.col("ratings"), F.col("est"))
    return rounded(lists.select("query_id", p.alias("precision"), r.alias("recall"), retrieval.f1(p, r).alias("f1")))


_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@REGISTRY.add(f"""select a.vec_id, round(avg((case when {_COS} is null then -1 else {_COS} end + 1) / 2), 5) as similarity from embeddings a join embeddings b on b.vec_id between a.vec_id + 1 and a.vec_id + 3 group by a.vec_id""")
def r9_semantic_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = e.select("vec_id", F.col("embedding").alias("query"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("other"))
    found = near.join(e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("chunk")), "other")
    lists = found.groupBy("vec_id").agg(F.any_value("query").alias("query"), F.collect_list("chunk").alias("chunks"))
    return lists.select("vec_id", F.round(retrieval.semantic_similarity(F.col("query"), F.col("chunks")), 5).alias("similarity"))


@REGISTRY.add(f"""select a.label, (select count(*) from embeddings x where x.label = a.label) as n, round(avg(1 - ({_COS} + 1) / 2), 5) as diversity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by a.label""")
def r10_group_diversity(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.group_diversity(table(spark, d, "embeddings"), "label", "embedding")
    return out.select("label", "n", F.round("diversity", 5).alias("diversity"))


@REGISTRY.add("select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x * x)), 5)::double as squared from embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(e, e), 5).alias("squared"))


# --- agent turns ---------------------------------------------------------------------------------------


def _typed(f: str, open_: str, close: str) -> str:
    s = f"regexp_replace({f}, '^\\s+|\\s+$', '', 'g')"
    objects = f" and len(list_filter(json_extract({s}, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0" if open_ == "[" else ""
    return f"(case when starts_with({s}, '{open_}') and ends_with({s}, '{close}') and json_valid({s}) then true{objects} else false end)"


@REGISTRY.add(f"""select row_id, coalesce({_typed('tools_available', '[', ']')}, false) as tools_typed, coalesce({_typed('tool_calls', '[', ']')}, false) as calls_typed, coalesce({_typed('parameters_passed', '{', '}')}, false) as parameters_typed,
  tools_available is not null and not coalesce({_typed('tools_available', '[', ']')}, false) as tools_raw,
  case when lower(trim(agent_exit)) in ('true', '1', 'yes', 'on') then true when lower(trim(agent_exit)) in ('false', '0', 'no', 'off') then false end as agent_exit from simple_agent_dataset""")
def pr5_typed_turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "simple_agent_dataset")
    typed = agents.typed_turns(t.withColumn("turn_id", F.col("row_id")))
    return typed.select(
        F.col("turn_id").cast("long").alias("row_id"), F.col("tools_available").isNotNull().alias("tools_typed"), F.col("tool_calls").isNotNull().alias("calls_typed"),
        F.col("parameters_passed").isNotNull().alias("parameters_typed"), F.col("tools_available_raw").isNotNull().alias("tools_raw"), "agent_exit",
    )


@REGISTRY.add("""with c as (select row_id, json_extract(tool_calls, '$[*]') as calls, case when json_valid(trim(tool_call_results)) and starts_with(trim(tool_call_results), '[') then json_extract(tool_call_results, '$[*]') else [] end as results from simple_agent_dataset
    where case when json_valid(trim(tool_calls)) and starts_with(trim(tool_calls), '[') then len(list_filter(json_extract(tool_calls, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0 else false end),
  k as (select row_id, unnest(calls) as c, (generate_subscripts(calls, 1) - 1)::int as pos, results from c)
  select row_id, pos, json_extract_string(c, '$.tool_name') as tool_name, json_extract_string(c, '$.call_id') as call_id,
    json_extract_string(list_filter(results, lambda r: json_extract_string(r, '$.call_id') = json_extract_string(c, '$.call_id'))[-1], '$.result') as result from k""")
def j3_calls_with_results(spark: SparkSession, d: str) -> DataFrame:
    typed = agents.typed_turns(table(spark, d, "simple_agent_dataset").withColumn("turn_id", F.col("row_id")))
    out = agents.calls_with_results(typed, ["turn_id"])
    return out.select(F.col("turn_id").cast("long").alias("row_id"), "pos", "tool_name", "call_id", "result")


@REGISTRY.add("""with t as (select row_id, agent_task, agent_role, system_prompt, agent_response, lower(trim(agent_exit)) in ('true', '1', 'yes', 'on') as exited, trace from simple_agent_dataset),
  m as (select *, list_filter([case when agent_task is null then 'agent_task' end, case when agent_role is null then 'agent_role' end, case when system_prompt is null then 'system_prompt' end, case when agent_response is null then 'agent_response' end], lambda x: x is not null) as missing from t)
  select row_id, case when len(missing) > 0 then 0.0 else (row_id % 5 + 1)::double end::double as progression, array_to_string(missing, ',') as missing,
    case when trace is null then 0.0 when not coalesce(exited, false) then -1.0 else 7.0 end::double as goal, trace is not null and coalesce(exited, false) as goal_valid from m""")
def ag_agent_scores(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "simple_agent_dataset")
    present = {f: F.col(f) for f in ("agent_task", "agent_role", "system_prompt", "agent_response", "trace")}
    progress = agents.agent_score("task_progression", F.concat(F.lit('{"score": '), (F.col("row_id") % 5 + 1).cast("string"), F.lit(', "reasoning": "r"}')), present)
    goal = agents.agent_score("goal_achievement", F.lit("score: 7"), present, text.truthy(F.col("agent_exit")))
    s = t.select("row_id", progress.alias("p"), goal.alias("g"))
    return s.select("row_id", F.col("p.score").alias("progression"), F.array_join("p.missing", ",").alias("missing"), F.col("g.score").alias("goal"), F.col("g.valid").alias("goal_valid"))


@REGISTRY.add("""with s as (select delivery_id::varchar || '/' || trace_id as task_id, unnest(spans) as s from sample_traces), f as (select task_id, s.span_id as turn_id, s.start_time as start, s.attributes as a from s where s.span_id is not null),
  l as (select *, lead(turn_id) over (partition by task_id order by start nulls first, turn_id) is null as agent_exit from f)
  select task_id, turn_id, bool_or(agent_exit) as agent_exit, count(*) as n from l group by task_id, turn_id""")
def w1_last_span(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "sample_traces").select(F.concat(F.col("delivery_id").cast("string"), F.lit("/"), F.col("trace_id")).alias("trace_id"), F.inline("spans").alias(
        "span_id", "t", "parent_span_id", "name", "start_time", "end_time", "duration_ms", "status", "status_message", "attributes")).where("span_id is not null")
    turns = agents.span_turns(spans.drop("t"))
    return turns.groupBy("task_id", "turn_id").agg(F.bool_or("agent_exit").alias("agent_exit"), F.count(F.lit(1)).alias("n"))


@REGISTRY.add("""with s as (select delivery_id, unnest(spans) as s, (generate_subscripts(spans, 1) - 1)::int as pos, len(spans) as n from sample_traces)
  select delivery_id, pos, s.name as name, pos = n - 1 as agent_exit from s where s is not null""")
def pr6_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = agents.trajectory_steps(table(spark, d, "sample_traces").select("delivery_id", "spans"), "spans")
    return steps.select("delivery_id", "pos", F.col("step.name").alias("name"), "agent_exit")


@REGISTRY.add("""with c as (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as c from documents where text is not null)
  select doc_id as query, len(c)::int as contexts, c[1] as first from c""")
def pr13_rag_samples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    out = agents.rag_samples(docs, "doc_id", "source", "lang", "text")
    return out.select("query", F.size("retrieved_contexts").alias("contexts"), F.try_element_at("retrieved_contexts", F.lit(1))["content"].alias("first"))


@REGISTRY.add("""select delivery_id from sample_traces where start_time >= '2025-02-01' and lower(environment) = 'production' and lower(status) = 'ok'""")
def f7_trace_search(spark: SparkSession, d: str) -> DataFrame:
    return samples.search_traces(table(spark, d, "sample_traces"), start="2025-02-01", environment="production", status="ok").select("delivery_id")


# --- conversations -------------------------------------------------------------------------------------


@REGISTRY.add("""with j as (select doc_id, case doc_id % 4 when 0 then '1. ' || repeat('k', 7) || chr(10) || '2) known fact' when 1 then 'none' when 2 then '1. abc' else '1. first fact' || chr(10) || 'x' || chr(10) || '3. third fact' end as k,
    case doc_id % 3 when 0 then 'NO' when 1 then 'YES' || chr(10) || 'asked twice' else 'yes' || chr(10) || 'a' || chr(10) || 'no b' || chr(10) || 'c' end as v, case when doc_id % 5 = 0 then '' else 'guide' end as role, 'I say ' || (doc_id % 5 + 1) as r from documents)
  select doc_id, round(case doc_id % 4 when 1 then 1.0 when 2 then 1.0 else greatest(0.0, 1 - case doc_id % 3 when 0 then 0 when 1 then 1 else 2 end / 2.0) end, 6)::double as retention,
    case when role = '' then 1.0 else (doc_id % 5 + 1) / 5.0 end::double as adherence,
    round((case doc_id % 4 when 1 then 1.0 when 2 then 1.0 else greatest(0.0, 1 - case doc_id % 3 when 0 then 0 when 1 then 1 else 2 end / 2.0) end + case when role = '' then 1.0 else (doc_id % 5 + 1) / 5.0 end) / 2, 6)::double as combined from j""")
def c1_c5_conversation_scores(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    k = F.when(i % 4 == 0, "1. kkkkkkk\n2) known fact").when(i % 4 == 1, "none").when(i % 4 == 2, "1. abc").otherwise("1. first fact\nx\n3. third fact")
    v = F.when(i % 3 == 0, "NO").when(i % 3 == 1, "YES\nasked twice").otherwise("yes\na\nno b\nc")
    keep = conversation.retention(k, v)
    role = conversation.role_adherence(F.when(i % 5 == 0, "").otherwise("guide"), F.concat(F.lit("I say "), (i % 5 + 1).cast("string")))
    return rounded(table(spark, d, "documents").select("doc_id", keep.alias("retention"), role.alias("adherence"), conversation.combined({"a": keep, "b": role}).alias("combined")))


@REGISTRY.add("""select user_id as conv_id, count(*) as turns, count(*) filter (event_type = 'click') as users, count(*) filter (event_type = 'view') as assistants from events group by user_id""")
def c3_turns_by_role(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "assistant").otherwise("other")
    turns = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), F.col("props").alias("text"))
    return conversation.by_role(turns).select("conv_id", "turns", "users", "assistants")


__all__ = ["REGISTRY", "r6"]
