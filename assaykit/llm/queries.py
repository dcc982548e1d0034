"""Queries of this subpackage over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import leakage, mixing, pairs, percentiles, residue

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    qa = pairs.pairs_of(table(spark, d, "qa_dataset"), "qa_dataset", "qa_id", "input", "expected")
    turns = pairs.pairs_of(table(spark, d, "simple_agent_dataset"), "simple_agent_dataset", "row_id", "agent_task", "agent_response")
    return pairs.find_defects(qa.unionByName(turns))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = percentiles.duration_percentiles(table(spark, d, "sample_traces"))
    return out.withColumn("low", F.round("low", 9)).withColumn("high", F.round("high", 9))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix_documents(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p3_percentiles, p6_found, p7_mix_documents, p7_mix_shares, p8_found)}
_ROWS = """with t as (select regexp_replace(lower(trim(project)), '[\\s_-]+', '-', 'g') as project, regexp_replace(lower(trim(environment)), '[\\s_-]+', '-', 'g') as environment,
  ingested_at::date as day, duration_ms::double as v from sample_traces where duration_ms is not null),
  q as (select unnest([0.5, 0.9, 0.95, 0.99])::double as q),
  d as (select project, environment, day, v, row_number() over (partition by project, environment, day order by v) as r, count(*) over (partition by project, environment, day) as n from t),
  a as (select project, environment, null::date as day, v, row_number() over (partition by project, environment order by v) as r, count(*) over (partition by project, environment) as n from t),
  x as (select * from d union all select * from a),
  p as (select project, environment, day, n, q, v, case when v = 0 then 0 else pow(2, floor(log2(abs(v))) - 12) end as step from x, q where r = greatest(1, ceil(round(q * n, 6))))"""

SQL: dict[str, str] = {
    # The bucket of a value keeps 12 bits of its mantissa; bounds are given to nine decimals.
    "p3_percentiles": f"""{_ROWS} select project, environment, day, n, q, round(case when v >= 0 then case when step = 0 then 0 else floor(v / step) * step end else -(floor(-v / step) + 1) * step end, 9)::double as low,
      round(case when v >= 0 then case when step = 0 then 0 else (floor(v / step) + 1) * step end else -floor(-v / step) * step end, 9)::double as high, case when day is null then v end as value from p""",
}
