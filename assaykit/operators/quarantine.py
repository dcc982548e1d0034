"""Loading raw delimited records while separating those that cannot be loaded.

Every record is parsed into cells, the cells are exploded into (record, column, value), a small rule
table is joined on the column, the rules are evaluated, and the errors of a record are aggregated.
Clean rows are those the aggregate does not name (anti-join).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions import jsonstrict

AGENT_COLUMNS = (
    "user_id", "task_id", "turn_id", "agent_name", "agent_role", "agent_task", "system_prompt",
    "agent_response", "trace", "tools_available", "tool_calls", "parameters_passed",
    "tool_call_results", "retrieval_query", "retrieved_context", "exit_status", "agent_exit",
    "ground_truth", "expected_tool_call", "metadata",
)

#: column -> rule; the rules are object_list, tool_call_list and object.
AGENT_RULES = {"trace": "object_list", "tool_calls": "tool_call_list", "metadata": "object"}

#: The first reason that applies holds.
REASONS = ("quoting", "column_count", "invalid_value")

# One field with the comma before it: quoted (doubled quotes inside, then a comma or the end) or bare.
# All quantifiers are possessive, so the matcher neither backtracks nor recurses on long records.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_RECORD = rf'(?s)\A(?:,(?:{_QUOTED}(?=,|\z)|(?!")[^,]*+))*+\z'
_FIELD = rf'(?s),({_QUOTED}|[^,]*+)'


def well_quoted(raw: Column) -> Column:
    return F.concat(F.lit(","), raw).rlike(_RECORD)


def split_record(raw: Column) -> Column:
    """The fields of a well-quoted record, unquoted."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(_FIELD), F.lit(1))
    return F.transform(
        cells,
        lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c),
    )


def _holds(rule: str, text: str) -> bool:
    try:
        value = jsonstrict.loads(text)
    except jsonstrict.Invalid:
        return False
    if rule == "object":
        return isinstance(value, dict)
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        return False
    return rule == "object_list" or all(
        isinstance(x.get("tool_name"), str) and isinstance(x.get("call_id"), str) and isinstance(x.get("parameters"), dict)
        for x in value
    )


@F.pandas_udf(T.BooleanType())
def _valid_json(rule: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([True if t is None else _holds(r, t) for r, t in zip(rule, text, strict=True)], dtype="bool")


def _parsed(df: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    raw = F.regexp_replace(F.coalesce(F.col("raw"), F.lit("")), r"\r\z", "")
    return (
        df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{raw_col}`").alias("raw"))
        .withColumn("key", F.xxhash64("raw"))
        .withColumn("cells", F.when(well_quoted(raw), split_record(raw)))
    )


def _errors(base: DataFrame, columns: Sequence[str], rules: dict[str, str]) -> DataFrame:
    verdict = F.when(F.col("cells").isNull(), "quoting").when((F.size("cells") != len(columns)) | F.col("raw").isNull(), "column_count").otherwise("")
    cell_rules = [(0, "", "record")] + [(1 + list(columns).index(c), c, r) for c, r in rules.items()]
    rule_table = base.sparkSession.createDataFrame(cell_rules, "pos int, column string, rule string")
    # Only the cells that a rule speaks about are exploded.
    ruled = [F.struct(F.lit(pos).alias("pos"), F.when(verdict == "", F.get("cells", pos - 1)).alias("value")) for pos, _, _ in cell_rules[1:]]
    cells = base.select("id", "key", F.inline(F.array(F.struct(F.lit(0).alias("pos"), verdict.alias("value")), *ruled))).join(F.broadcast(rule_table), "pos")  # as many rows as there are rules
    text = F.regexp_replace("value", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    is_json = (F.col("rule") != "record") & text.rlike(r"\A[\[{]")
    checked = cells.withColumn("valid", _valid_json("rule", F.when(is_json, text)))
    error = (
        F.when(F.col("rule") == "record", F.expr("nullif(value, '')"))
        .when(~F.col("valid") | F.col("value").contains("\ufffd"), "invalid_value")
    )
    order = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    return (
        checked.withColumn("reason", error)
        .where(F.col("reason").isNotNull())
        .groupBy("id", "key")
        .agg(F.min_by("reason", order).alias("reason"), F.sort_array(F.collect_set(F.struct("reason", "column"))).alias("errors"))
    )


def load_records(
    df: DataFrame,
    id_col: str = "line_id",
    raw_col: str = "raw_line",
    columns: Sequence[str] = AGENT_COLUMNS,
    rules: dict[str, str] = AGENT_RULES,
) -> tuple[DataFrame, DataFrame]:
    """Split raw records into (clean rows, rejected rows).

    clean: id_col and the named columns as strings. rejected: id_col, raw_col, reason, errors, where
    errors lists every (reason, column) found and reason is the first of REASONS among them.

    Rows are identified by id and text together, so rows repeated with both equal share a verdict and
    come out of `rejected` once; in `clean` every copy stays. A null record has no fields and fails with
    column_count; so does an empty one unless a single column is expected. An empty table gives two
    empty tables. Other input columns are ignored, whatever their names. Ids may be null.
    """
    base = _parsed(df, id_col, raw_col)
    b, e = base.alias("b"), _errors(base, columns, rules).alias("e")
    same = F.expr("b.id <=> e.id and b.key = e.key")
    clean = b.join(e, same, "left_anti").select(F.col("id").alias(id_col), *[F.col("cells")[i].alias(c) for i, c in enumerate(columns)])
    rejected = (
        e.join(b, same)
        .groupBy(F.col("e.id").alias("id"), F.col("e.key").alias("key"))
        .agg(F.any_value("b.raw").alias(raw_col), F.any_value("e.reason").alias("reason"), F.any_value("e.errors").alias("errors"))
        .select(F.col("id").alias(id_col), raw_col, "reason", "errors")
    )
    return clean, rejected


def failing_records(
    df: DataFrame,
    id_col: str = "line_id",
    raw_col: str = "raw_line",
    columns: Sequence[str] = AGENT_COLUMNS,
    rules: dict[str, str] = AGENT_RULES,
) -> DataFrame:
    """(id, reason) of what load_records rejects, without the texts and so without a join."""
    return _errors(_parsed(df, id_col, raw_col), columns, rules).select(F.col("id").alias(id_col), "reason")
