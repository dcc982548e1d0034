"""Queries of aggregates, request metrics, panels, run comparison and stage metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit import streaming
from assaykit.operators import aggregates, conversation, requests, samples, stages
from assaykit.plans.registry import Registry, r6, rounded, table

REGISTRY = Registry()


# --- scores by key -------------------------------------------------------------------------------------

_TURNS = """with t as (select user_id, task_id, turn_id, agent_name, length(agent_response)::double as chars,
  case when row_id % 7 = 0 then 'nan'::double else (row_id % 10)::double end as rating from simple_agent_dataset)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("row_id")
    rating = F.when(i % 7 == 0, F.lit(float("nan"))).otherwise((i % 10).cast("double"))
    return table(spark, d, "simple_agent_dataset").select("user_id", "task_id", "turn_id", "agent_name", F.length("agent_response").cast("double").alias("chars"), rating.alias("rating"))


def _by_key(key: str) -> str:
    x = "case when isnan(rating) then null else rating end"
    return f"""{_TURNS} select {key}, round(coalesce(avg(chars), 0), 6) as mean_chars, round(coalesce(avg({x}), 0), 6) as mean_rating, coalesce(max(chars), 0) as max_chars, coalesce(max({x}), 0) as max_rating,
      round(coalesce(max(chars) - min(chars), 0), 6) as range_chars, round(coalesce(max({x}) - min({x}), 0), 6) as range_rating from t where {key} is not null group by {key}"""


@REGISTRY.add(_by_key("task_id"))
def a2_by_task(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.aggregate_by(_turns(spark, d), "task_id", ("mean", "max", "range")))


@REGISTRY.add(_by_key("user_id"))
def a3_by_user(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.aggregate_by(_turns(spark, d), "user_id", ("mean", "max", "range")))


@REGISTRY.add(_by_key("agent_name"))
def a4_by_agent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.aggregate_by(_turns(spark, d), "agent_name", ("mean", "max", "range")))


_LONG = """with l as (select l_returnflag as model, l_linestatus as scorer, l_orderkey::varchar as sample_id, l_quantity as score from lineitem
  union all select l_returnflag, 'discount', l_orderkey::varchar, l_discount from lineitem)"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    each = F.array(F.struct(F.col("l_linestatus").alias("scorer"), F.col("l_quantity").alias("score")), F.struct(F.lit("discount").alias("scorer"), F.col("l_discount").alias("score")))
    return li.select(F.col("l_returnflag").alias("model"), F.col("l_orderkey").cast("string").alias("sample_id"), F.inline(each))


@REGISTRY.add(f"{_LONG} select model, scorer, round(avg(score), 6) as mean, count(score) as count, min(score) as min, max(score) as max, round(coalesce(stddev_samp(score), 0), 6) as std from l group by model, scorer")
def a6_score_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.describe_scores(_long(spark, d), ["model", "scorer"]))


@REGISTRY.add(f"""{_LONG}, m as (select scorer, model, avg(score) as m from l group by scorer, model)
  select m.scorer, round(avg(m), 6) as mean_of_models, round(min(m), 6) as min, round(max(m), 6) as max, (select count(distinct sample_id) from l where l.scorer = m.scorer) as samples from m group by m.scorer""")
def a8_model_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.model_summary(_long(spark, d)))


@REGISTRY.add(f"""{_LONG}, m as (select scorer, model, avg(score) as mean, row_number() over (partition by scorer order by avg(score) desc, model) as r from l group by scorer, model)
  select scorer, model, round(mean, 6) as mean from m where r = 1""")
def a9_best_models(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.best_models(_long(spark, d)))


# --- requests ------------------------------------------------------------------------------------------

_REQUESTS = """with e as (select value as latency, case when event_id % 3 = 0 then null else value / 4 end as ttfb, case when event_id % 5 = 0 then null else cast(json_extract(props, '$.k') as bigint) end as tokens_input,
  (event_id % 50)::bigint as tokens_output, case when event_id % 4 = 0 then null else (event_id % 100) / 1000.0::double end as cost, event_type <> 'error' as success,
  case when event_id % 2 = 0 then '' else event_type end as error_type, event_type as provider, case when user_id % 7 = 0 then null else 'm' || (user_id % 7) end as model from events)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select(
        F.col("value").alias("latency"), F.when(i % 3 != 0, F.col("value") / 4).alias("ttfb"), F.when(i % 5 != 0, F.get_json_object("props", "$.k").cast("long")).alias("tokens_input"),
        (i % 50).cast("long").alias("tokens_output"), F.when(i % 4 != 0, (i % 100) / 1000.0).alias("cost"), (F.col("event_type") != "error").alias("success"),
        F.when(i % 2 == 0, "").otherwise(F.col("event_type")).alias("error_type"), F.col("event_type").alias("provider"), F.when(u % 7 != 0, F.concat(F.lit("m"), (u % 7).cast("string"))).alias("model"),
    )


_METRICS = """count(*) as requests, count(*) filter (success) as successes, count(*) filter (not success) as errors,
  round(coalesce(100.0 * count(*) filter (success) / nullif(count(*), 0), 0), 6) as success_rate, round(coalesce(100.0 * count(*) filter (not success) / nullif(count(*), 0), 0), 6) as error_rate,
  round(coalesce(avg(latency), 0), 6) as latency_avg, round(coalesce(quantile_cont(latency, 0.5), 0), 6) as latency_p50, round(coalesce(quantile_cont(latency, 0.95), 0), 6) as latency_p95, round(coalesce(quantile_cont(latency, 0.99), 0), 6) as latency_p99,
  round(coalesce(avg(ttfb), 0), 6) as ttfb_avg, round(coalesce(quantile_cont(ttfb, 0.5), 0), 6) as ttfb_p50, round(coalesce(quantile_cont(ttfb, 0.95), 0), 6) as ttfb_p95, round(coalesce(quantile_cont(ttfb, 0.99), 0), 6) as ttfb_p99,
  coalesce(sum(tokens_input + tokens_output), 0)::double as tokens_total, round(coalesce(coalesce(sum(tokens_input + tokens_output), 0)::double / nullif(count(*), 0), 0), 6) as tokens_per_request,
  round(coalesce(avg(tokens_input), 0), 6) as tokens_input_avg, round(coalesce(avg(tokens_output), 0), 6) as tokens_output_avg,
  round(coalesce(sum(cost), 0), 6) as cost_total, round(coalesce(avg(cost), 0), 6) as cost_avg, round(case when sum(tokens_input + tokens_output) > 0 then coalesce(sum(cost), 0) / sum(tokens_input + tokens_output)::double * 1000 else 0.0 end, 6)::double as cost_per_1k"""


@REGISTRY.add(f"{_REQUESTS} select {_METRICS} from e")
def a10_request_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(requests.request_metrics(_requests(spark, d)))


@REGISTRY.add(f"""{_REQUESTS} select 'overall' as level, 'all' as key, {_METRICS} from e union all select 'provider', provider, {_METRICS} from e where provider <> '' group by provider
  union all select 'model', model, {_METRICS} from e where model <> '' group by model""")
def a11_request_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(requests.metric_levels(_requests(spark, d)))


@REGISTRY.add(f"""{_REQUESTS}, b as (select case when latency >= 900 then 9 when latency >= 0 then floor(latency / 100)::int end as b from e)
  select case when i = 9 then '900ms+' else (i * 100) || '-' || ((i + 1) * 100) || 'ms' end as bucket, count(b) as n from range(0, 10) r(i) left join b on b.b = i group by i""")
def a14_latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return requests.latency_histogram(_requests(spark, d))


@REGISTRY.add(f"{_REQUESTS} select coalesce(nullif(error_type, ''), 'unknown') as error_type, count(*) as n from e where not success group by 1")
def a15_error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return requests.error_breakdown(_requests(spark, d))


@REGISTRY.add(f"""{_REQUESTS} select model, round(sum(case when model = 'm1' then (coalesce(tokens_input, 0) * case when coalesce(tokens_input, 0) >= 50 then 2.0 else 1.0 end + tokens_output * 3.0) / 1e6
  when model = 'm2' then (coalesce(tokens_input, 0) * 5.0 + tokens_output * 6.0) / 1e6 else 0.0 end), 9)::double as cost from e where model is not null group by model""")
def j9_j10_priced(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("m1", 0, 1.0, 3.0), ("m1", 50, 2.0, 3.0), ("m2", 0, 5.0, 6.0)], "model string, from_tokens long, per_million_input double, per_million_output double")
    out = requests.priced(_requests(spark, d), prices).where("model is not null")
    return out.groupBy("model").agg(F.round(F.sum("cost"), 9).alias("cost"))


@REGISTRY.add(f"{_REQUESTS} select count(*) as total_requests, count(distinct nullif(provider, '')) as unique_providers, count(distinct nullif(model, '')) as unique_models from e")
def a16_export_summary(spark: SparkSession, d: str) -> DataFrame:
    return requests.export_summary(_requests(spark, d))


@REGISTRY.add(f"{_REQUESTS} select provider, count(*) as requests, sum(coalesce(tokens_input, 0) + coalesce(tokens_output, 0))::bigint as tokens, round(coalesce(sum(cost), 0), 6) as cost, count(*) filter (not success) as errors from e group by provider")
def a25_running_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(requests.running_totals(_requests(spark, d), "provider"))


@REGISTRY.add("select l_returnflag, q::double as q, round(quantile_cont(l_extendedprice, q), 4) as value from lineitem, (select unnest([0.5, 0.95, 0.99]) as q) group by l_returnflag, q".replace("quantile_cont(l_extendedprice, q)", "case q when 0.5 then quantile_cont(l_extendedprice, 0.5) when 0.95 then quantile_cont(l_extendedprice, 0.95) else quantile_cont(l_extendedprice, 0.99) end"))
def a10_percentiles_of_any_size(spark: SparkSession, d: str) -> DataFrame:
    out = requests.exact_percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.withColumn("value", F.round("value", 4))


# --- panels --------------------------------------------------------------------------------------------

_VOTES = "with v as (select user_id::varchar as sample_id, event_type as judge, (event_id % 4)::double as weight, (event_id % 11) / 10.0::double as score from events)"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("sample_id"), F.col("event_type").alias("judge"), (i % 4).cast("double").alias("weight"), ((i % 11) / 10.0).alias("score"))


@REGISTRY.add(f"""{_VOTES} select sample_id, round(avg(score), 6) as mean, round(median(score), 6) as median, round(case when sum(weight) <> 0 then sum(score * weight) / sum(weight) else avg(score) end, 6) as weighted_mean,
  (count(*) filter (score >= 0.5) > count(*) / 2.0)::double as majority, case when min(score) >= 0.5 then min(score) else 0.0 end::double as consensus, min(score) as min, max(score) as max,
  round(coalesce(greatest(0, 1 - stddev_samp(score) / 0.5), 1.0), 6) as consensus_level from v group by sample_id""")
def a18_a19_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.panel(_votes(spark, d)))


@REGISTRY.add(f"{_VOTES} select sample_id, round(avg(score), 6) as score, round(case when count(*) > 1 then greatest(0, 1 - var_pop(score)) else 0.8 end, 6)::double as confidence from v group by sample_id")
def a20_repeated_judgements(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.repeated_judgements(_votes(spark, d)))


@REGISTRY.add("""select event_id, round((coalesce(a, 0) * 0.25 + coalesce(b, 0) * 0.75), 6)::double as filled, round(case when a is null and b is null then 0 else (coalesce(a, 0) * 0.25 + coalesce(b, 0) * 0.75) / (case when a is null then 0 else 0.25 end + case when b is null then 0 else 0.75 end) end, 6)::double as skipped
  from (select event_id, case when event_id % 3 = 0 then null else value end as a, case when event_id % 5 = 0 then null else value / 2 end as b from events)""")
def a21_weighted_composite(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    rows = table(spark, d, "events").select("event_id", F.when(i % 3 != 0, v).alias("a"), F.when(i % 5 != 0, v / 2).alias("b"))
    w = {"a": 0.25, "b": 0.75}
    return rounded(rows.select("event_id", aggregates.weighted_composite(w).alias("filled"), aggregates.weighted_composite(w, "skip").alias("skipped")))


@REGISTRY.add("select count(*) filter (value < 20)::bigint as failed, count(*) as total, coalesce(bool_and(value >= 20), true) as passed, case when coalesce(bool_and(value >= 20), true) then 'deploy' else 'do not deploy' end as verdict from events")
def f12_gate(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.gate(table(spark, d, "events").select(F.col("value").alias("score")), 20.0)


@REGISTRY.add("select count(distinct user_id) as models, count(distinct event_type) as datasets, round(avg(value), 6) as avg_score, round(min(value), 6) as min_score, round(max(value), 6) as max_score from events")
def a23_job_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("model"), F.col("event_type").alias("dataset"), F.col("value").alias("score"))
    return rounded(aggregates.job_summary(rows))


# --- comparing runs ------------------------------------------------------------------------------------

_RUNS = """with o as (select l_orderkey || '_' || l_linenumber as sample_id, l_returnflag as subset, l_discount as score from lineitem where l_linenumber <> 7),
  n as (select l_orderkey || '_' || l_linenumber as sample_id, l_returnflag as subset, case when l_partkey % 5 = 0 then l_tax else l_discount end as score from lineitem where l_linenumber <> 6),
  d as (select coalesce(o.sample_id, n.sample_id) as sample_id, coalesce(o.subset, n.subset) as subset, o.score as original_score, n.score as new_score, round(coalesce(n.score, 0) - coalesce(o.score, 0), 6) as difference
    from o full join n on o.sample_id = n.sample_id and o.subset = n.subset where o.score is distinct from n.score)"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("sample_id", F.concat_ws("_", "l_orderkey", "l_linenumber")).withColumn("subset", F.col("l_returnflag"))
    old = li.where("l_linenumber <> 7").select("sample_id", "subset", F.col("l_discount").alias("score"))
    new = li.where("l_linenumber <> 6").select("sample_id", "subset", F.when(F.col("l_partkey") % 5 == 0, F.col("l_tax")).otherwise(F.col("l_discount")).alias("score"))
    return aggregates.score_diff(old, new, extra=["subset"])


@REGISTRY.add(f"{_RUNS} select sample_id, subset, original_score, new_score, difference from d")
def j5_score_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_diff(spark, d))


@REGISTRY.add(f"{_RUNS} select subset, count(*) as n, round(sum(abs(difference)), 6) as total from d group by subset")
def a26_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.diff_summary(_diff(spark, d), "subset"))


@REGISTRY.add("select l_returnflag as subset, round(avg(l_quantity), 6) as mean, count(l_quantity) as n from lineitem group by rollup (l_returnflag)")
def a27_subset_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.subset_means(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("subset"), F.col("l_quantity").alias("score"))))


@REGISTRY.add("""select l_suppkey as run, count(l_discount) as n, round(sum(l_discount), 6) as correct, round(avg(l_discount), 6) as accuracy, round(avg(l_quantity), 6) as token_mean, round(stddev_samp(l_quantity), 6) as token_std,
  round(avg(l_extendedprice / 1000), 6) as cost_mean, round(stddev_samp(l_extendedprice / 1000), 6) as cost_std from lineitem group by l_suppkey""")
def a28_run_performance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("tokens"), (F.col("l_extendedprice") / 1000).alias("cost"))
    return rounded(aggregates.run_performance(rows, ["run"]))


_MEANS = "with m as (select l_suppkey as subset, l_returnflag as model, avg(l_discount) * 10 as accuracy from lineitem group by 1, 2)"


def _means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subset"), F.col("l_returnflag").alias("model")).agg((F.avg("l_discount") * 10).alias("accuracy"))


@REGISTRY.add(f"{_MEANS} select subset, round(1 - avg(accuracy), 6) as difficulty, round(stddev_pop(accuracy), 6) as std, count(*) as n from m group by subset having count(*) > 1")
def a29_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.difficulty(_means(spark, d)))


@REGISTRY.add(f"{_MEANS} select subset, round(avg(accuracy), 6) as mean, round(stddev_pop(accuracy), 6) as std, round(max(accuracy) - min(accuracy), 6) as range, count(*) as n, round(stddev_pop(accuracy) / avg(accuracy), 6) as cv from m group by subset having count(*) > 1")
def a30_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.consistency(_means(spark, d), "subset"))


@REGISTRY.add("""with b as (select l_quantity as x, l_discount as y from lineitem), r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from b)
  select count(*) as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from r""")
def a31_correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.correlations(table(spark, d, "lineitem"), "l_quantity", "l_discount"))


@REGISTRY.add("""with s as (select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 as w from lineitem)
  select greatest(1, least(10, ceil(round((l_extendedprice - lo) / w, 9))))::int as bin, round(avg(l_quantity), 6) as mean, count(*) as n from lineitem, s group by 1""")
def a32_equal_width_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.equal_width_bins(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity"))


@REGISTRY.add(f"""{_MEANS}, s as (select avg(accuracy) as a, stddev_pop(accuracy) as s from m), z as (select m.*, (accuracy - a) / s.s as z from m, s)
  select subset, model, round(accuracy, 6) as accuracy, round(z, 6) as z, case when z > 0 then 'high' else 'low' end as kind from z where abs(z) > 1.96""")
def a33_outliers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.outliers(_means(spark, d)))


@REGISTRY.add(f"{_MEANS} select subset, model, round(accuracy, 6) as accuracy, (row_number() over (partition by subset order by accuracy desc, model))::int as rank from m")
def w5_ranked_models(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.ranked(_means(spark, d)))


@REGISTRY.add("select o_orderkey, o_orderpriority, (rank() over (partition by o_orderpriority order by floor(o_totalprice / 1000)) + (count(*) over (partition by o_orderpriority, floor(o_totalprice / 1000)) - 1) / 2.0)::double as r from orders")
def w10_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("thousands"))
    return aggregates.average_ranks(rows, "thousands", "r", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", F.col("r").cast("double").alias("r"))


# --- stages, conversations, streams in batch -----------------------------------------------------------

_STAGES = "with s as (select user_id as sample_id, case event_type when 'click' then 'retrieval' when 'view' then 'generation' else event_type end as stage_name, value * 30 as latency_ms, event_id % 9 <> 0 as success from events)"


@REGISTRY.add(f"""{_STAGES}, a as (select sample_id, count(*) as stages, count(*) filter (success) / count(*)::double as success_rate, case when avg(latency_ms) > 0 then greatest(0, 1 - stddev_pop(latency_ms) / avg(latency_ms)) else 0 end as steady,
    count(*) filter (latency_ms between 10 and 10000) / count(*)::double as reasonable, sum(latency_ms) as total, max(latency_ms) as slowest, count(*) filter (success and latency_ms < 1000) / count(*)::double as cpu, 1 - count(*) filter (not success) / count(*)::double as isolation,
    case count(*) filter (not success and stage_name in ('query_processing', 'retrieval', 'generation')) when 0 then 1.0 when 1 then 0.5 else 0.0 end as recovery from s group by sample_id)
  select sample_id, stages, round((success_rate + steady + reasonable) / 3, 6) as coordination, case when total < 1000 then 0.9 when total < 5000 then 0.7 when total < 10000 then 0.5 else 0.2 end::double as latency_score,
    round((cpu + success_rate + (cpu + success_rate) / 2) / 3, 6) as resources, round((isolation + recovery::double) / 2, 6) as error_handling, round(slowest, 6) as max_latency from a""")
def rp4_rp7_stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stage = F.when(F.col("event_type") == "click", "retrieval").when(F.col("event_type") == "view", "generation").otherwise(F.col("event_type"))
    s = e.select(F.col("user_id").alias("sample_id"), stage.alias("stage_name"), (F.col("value") * 30).alias("latency_ms"), (F.col("event_id") % 9 != 0).alias("success"))
    return rounded(stages.stage_metrics(s).select("sample_id", "stages", "coordination", "latency_score", "resources", "error_handling", "max_latency"))


@REGISTRY.add("""select event_id, len(w)::int as n, len(list_filter(w, lambda x: x = 'click'))::int as clicks, coalesce(w[-1], '') as last from
  (select event_id, coalesce(list(event_type) over (partition by user_id order by event_id rows between 5 preceding and 1 preceding), []) as w from events)""")
def w3_context_window(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"), F.col("props").alias("text"))
    w = conversation.context_window(turns)
    roles = F.transform("window", lambda x: x["role"])
    return w.select(F.col("turn").alias("event_id"), F.size("window").alias("n"), F.size(F.filter(roles, lambda r: r == "click")).alias("clicks"), F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("last"))


@REGISTRY.add("""select time_bucket(interval '5 minutes', ts) as window_start, time_bucket(interval '5 minutes', ts) + interval '5 minutes' as window_end, event_type, count(*) as n, round(avg(value), 6) as avg_value, round(max(value), 6) as max_value from events group by 1, 2, 3""")
def st4_request_windows(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.windowed_requests(table(spark, d, "events"))
    return rounded(out)


@REGISTRY.add("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events),
  s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
  select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, s.s""")
def st4_request_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streaming.request_sessions(table(spark, d, "events"))


# --- choosing and comparing samples --------------------------------------------------------------------


@REGISTRY.add("""select i.item_id, i.subset, coalesce(max(d.n_chars), 0)::double as score from eval_items i left join documents d on d.doc_id + 1000 = i.item_id group by 1, 2""")
def j4_score_lookup(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "documents").select((F.col("doc_id") + 1000).alias("item_id"), F.col("n_chars").cast("double").alias("score"))
    return samples.with_scores(table(spark, d, "eval_items").select("item_id", "subset"), scores, "item_id")


@REGISTRY.add("""select o.o_orderpriority as subset, round(coalesce(avg(l.l_quantity), -1), 6)::double as mean from orders o left join lineitem l on l.l_orderkey = o.o_orderkey and o.o_orderpriority < '4' group by 1""")
def j6_refreshed_means(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    detail = orders.where("o_orderpriority < '4'").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("subset"), F.col("l_quantity").alias("score"))
    summary = orders.select(F.col("o_orderpriority").alias("subset")).distinct().withColumn("mean", F.lit(-1.0))
    return rounded(samples.refreshed_means(summary, detail))


@REGISTRY.add("""select c_custkey, case when c_custkey % 7 = 0 then 'NEW' else c_mktsegment end as c_mktsegment from customer where c_custkey % 11 <> 3""")
def sk11_upsert(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    changes = current.where((k % 7 == 0) | (k % 11 == 3)).select(k, F.when(k % 7 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), (k % 11 == 3).alias("_deleted"))
    return samples.upsert(current, changes, ["c_custkey"])


@REGISTRY.add(f"""{_STAGES}, a as (select sample_id, count(*) filter (not success) as failed, max(latency_ms) as slowest, avg(case when success then 1.0 else 0.0 end) as ok from s group by sample_id)
  select sample_id, round(0.3 * ok + 0.4 * 0.5 + 0.2 * ok + 0.1 * 1.0, 6)::double as overall,
    ((failed > 0)::int + (slowest > 2000)::int + (ok < 0.6)::int + (ok < 0.7)::int)::int as advice from a""")
def rp8_rp10_overall(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.groupBy(F.col("user_id").alias("sample_id")).agg(F.count_if(F.col("event_id") % 9 == 0).alias("failed"), F.max(F.col("value") * 30).alias("slowest"), F.avg((F.col("event_id") % 9 != 0).cast("double")).alias("ok"))
    overall = stages.overall(F.col("ok"), F.lit(0.5), F.col("ok"), F.lit(1.0))
    advice = stages.recommendations(F.col("ok"), F.col("slowest"), F.col("failed"), F.col("ok"), F.lit(1.0))
    return a.select("sample_id", r6(overall).alias("overall"), F.size(advice).alias("advice"))


@REGISTRY.add("select doc_id, source from documents where doc_id is not null order by n_chars desc nulls last, doc_id offset 20 limit 30")
def o3_page(spark: SparkSession, d: str) -> DataFrame:
    return samples.page(table(spark, d, "documents"), [F.col("n_chars").desc_nulls_last(), "doc_id"], 20, 30).select("doc_id", "source")


@REGISTRY.add("""with o as (select doc_id, lang, n_chars from documents where doc_id % 10 <> 1), n as (select doc_id, case when doc_id % 4 = 0 then 'xx' else lang end as lang, n_chars from documents where doc_id % 10 <> 2)
  select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' else 'changed' end as change from o full join n on o.doc_id = n.doc_id
  where o.doc_id is null or n.doc_id is null or o.lang is distinct from n.lang or o.n_chars is distinct from n.n_chars""")
def x2_version_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    new = docs.where("doc_id % 10 <> 2").withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")))
    return samples.version_diff(docs.where("doc_id % 10 <> 1"), new, ["doc_id"])


@REGISTRY.add("select qa_id::varchar as id, input, expected, dataset_slug as original_dataset_slug from qa_dataset where input is not null and expected is not null")
def pr1_canonical_samples(spark: SparkSession, d: str) -> DataFrame:
    out = samples.canonical(table(spark, d, "qa_dataset").drop("metadata"), id_col="qa_id")
    return out.select("id", "input", "expected", "original_dataset_slug")


@REGISTRY.add("select model, lang, count(*) as n from (select unnest(['small', 'large']) as model) m, documents group by 1, 2")
def j2_models_by_samples(spark: SparkSession, d: str) -> DataFrame:
    return samples.for_models(table(spark, d, "documents").select("lang"), ["small", "large"]).groupBy("model", "lang").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.add("select item_id, subset from eval_items i where not exists (select 1 from documents d where d.doc_id + 1000 = i.item_id and d.lang is not null)")
def j7_items_without_result(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "documents").where("lang is not null").select((F.col("doc_id") + 1000).alias("item_id"))
    return samples.without_result(table(spark, d, "eval_items"), results).select("item_id", "subset")


@REGISTRY.add("select count(distinct doc_id) as docs, count(distinct source) as sources, count(distinct lang) as langs from documents")
def x3_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


__all__ = ["REGISTRY", "r6"]
