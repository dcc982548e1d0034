"""Queries of the general data-preparation operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaykit.operators import packed, quarantine, shredding

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.failing_records(table(spark, d, "agent_csv_lines"))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.load_records(table(spark, d, "agent_csv_lines"))[0]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.span_table(table(spark, d, "sample_traces"), table(spark, d, "trace_payloads"))


def p4_attributes(spark: SparkSession, d: str) -> DataFrame:
    return shredding.attribute_table(table(spark, d, "sample_traces"), table(spark, d, "trace_payloads"))


def p4_traces(spark: SparkSession, d: str) -> DataFrame:
    return shredding.trace_table(table(spark, d, "sample_traces"), table(spark, d, "trace_payloads"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.explode_packed(table(spark, d, "simple_agent_dataset"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_loaded, p4_found, p4_attributes, p4_traces, p5_found)}

# The record's fields after a leading comma each; a quoted field holds doubled quotes, a bare one starts with none.
_FIELDS = """f as (select line_id, ',' || regexp_replace(coalesce(raw_line, ''), '\\r$', '') as s, raw_line is null as missing from agent_csv_lines),
  c as (select *, regexp_full_match(s, '(?s)(,("[^"]*(""[^"]*)*"|[^",][^,]*)?)*') as quoted,
    list_transform(regexp_extract_all(s, '(?s),("[^"]*(?:""[^"]*)*"|[^,]*)', 1), lambda x: case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end) as cells from f)"""
_CELL = "regexp_replace(cells[{0}], '^\\s+|\\s+$', '', 'g')"
_OBJECTS = "(json_valid({0}) and json_type({0}) = 'ARRAY' and len(list_filter(json_extract({0}, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0)"


def _bad(place: int, rule: str) -> str:
    x = _CELL.format(place)
    ok = {
        "object": f"(json_valid({x}) and json_type({x}) = 'OBJECT')",
        "objects": _OBJECTS.format(x),
        "calls": f"""({_OBJECTS.format(x)} and len(list_filter(json_extract({x}, '$[*]'), lambda c: not (coalesce(json_type(json_extract(c, '$.tool_name')), '') = 'VARCHAR'
          and coalesce(json_type(json_extract(c, '$.call_id')), '') = 'VARCHAR' and coalesce(json_type(json_extract(c, '$.parameters')), '') = 'OBJECT'))) = 0)""",
    }[rule]
    # DuckDB also reads NaN, Infinity and commas before a closing bracket; strings aside, they must not occur.
    bare = rf"""regexp_replace({x}, '"(\\.|[^"\\])*"', '0', 'g')"""
    strict = f"not regexp_matches({bare}, ',\\s*[\\]}}]|NaN|nan|Inf|inf')"
    return f"(contains(cells[{place}], chr(65533)) or (regexp_matches({x}, '^[\\[{{]') and not case when json_valid({x}) then {ok} and {strict} else false end))"


_REASON = f"""case when not quoted then 'quoting' when len(cells) <> 20 or missing then 'column_count'
      when {_bad(9, 'objects')} or {_bad(11, 'calls')} or {_bad(20, 'object')} then 'invalid_value' end"""
_CELLS = ", ".join(f"cells[{i}] as {c}" for i, c in enumerate(quarantine.AGENT_COLUMNS, 1))
_OBJECT_ROWS = """t as (select payload_id, j.fullkey, j.value from trace_payloads, json_tree(body) j where json_valid(body) and j.type = 'OBJECT'),
      o as (select payload_id, fullkey, value, json_extract_string(value, '$.span_id') as sid, json_extract_string(value, '$.trace_id') as tid from t),
      s as (select *, json_extract(value, '$.attributes') as a, json_extract_string(value, '$.parent_span_id') as p from o where sid is not null),
      r as (select s.payload_id, s.fullkey, arg_max(x.tid, length(x.fullkey)) as tid from s join o x on x.payload_id = s.payload_id and x.sid is null and x.tid is not null
        and (starts_with(s.fullkey, x.fullkey || '.') or starts_with(s.fullkey, x.fullkey || '[')) group by 1, 2)"""

SQL: dict[str, str] = {
    "p2_found": f"with {_FIELDS}, r as (select line_id, {_REASON} as reason from c) select line_id, reason from r where reason is not null",
    "p2_loaded": f"with {_FIELDS}, r as (select *, {_REASON} as reason from c) select line_id, {_CELLS} from r where reason is null",
    "p4_traces": f"""with {_OBJECT_ROWS}, b as (select trace_id, project, environment from sample_traces where trace_id is not null
        union all select tid, json_extract_string(value, '$.project'), json_extract_string(value, '$.environment') from o where sid is null and tid is not null)
      select trace_id, max(project) as project, max(environment) as environment, count(*) as deliveries from b group by trace_id""",
    "p4_attributes": f"""with {_OBJECT_ROWS}, x as (select s.sid, coalesce(r.tid, '') as tid, s.a from s left join r using (payload_id, fullkey)),
      d as (select tid, sid, replace(substr(j.fullkey, 3), '"', '') as key, json_extract_string(j.atom, '$') as value from x, json_tree(case when json_type(a) = 'OBJECT' then a else '{{}}'::json end) j where j.atom is not null),
      l as (select tid, sid, unnest(json_extract(a, '$[*]')) as e from x where json_type(a) = 'ARRAY'),
      b as (select trace_id as tid, unnest(spans) as s from sample_traces), m as (select coalesce(tid, '') as tid, s.span_id as sid, unnest(map_entries(s.attributes)) as e from b where s.span_id is not null),
      u as (select tid, sid, key, value from d union all select tid, sid, json_extract_string(e, '$.key'), coalesce(json_extract_string(e, '$.value.stringValue'), json_extract_string(e, '$.value.intValue')) from l union all select tid, sid, e.key, e.value from m)
      select distinct tid as trace_id, sid as span_id, key, value from u""",
    "p4_found": f"""with {_OBJECT_ROWS},
      e as (select s.payload_id, s.fullkey, arg_max(x.sid, length(x.fullkey)) as inside from s join s x on x.payload_id = s.payload_id
        and (starts_with(s.fullkey, x.fullkey || '.') or starts_with(s.fullkey, x.fullkey || '[')) group by 1, 2),
      f as (select r.tid, s.sid, s.p, e.inside, coalesce(json_extract_string(a, '$."operation.type"'), json_extract_string(a, '$.operation.type'),
          json_extract_string(list_filter(json_extract(a, '$[*]'), lambda x: json_extract_string(x, '$.key') = 'operation.type')[1], '$.value.stringValue')) as op
        from s left join r using (payload_id, fullkey) left join e using (payload_id, fullkey)),
      b as (select trace_id as tid, unnest(spans) as s from sample_traces), u as (select tid, s.span_id as sid, s.parent_span_id as p, null as inside, s.attributes['operation.type'] as op from b where s.span_id is not null union all select * from f)
      select coalesce(tid, '') as trace_id, sid as span_id, max(case when regexp_full_match(trim(coalesce(p, '')), '[0-]*') then coalesce(inside, '') else p end) as parent_span_id, max(coalesce(op, '')) as operation_type from u group by 1, 2""",
}
