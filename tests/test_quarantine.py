import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assaykit.operators.quarantine import AGENT_COLUMNS, failing_records, load_records

TRACE, CALLS, META = (AGENT_COLUMNS.index(c) for c in ("trace", "tool_calls", "metadata"))


def record(**cells):
    fields = [f"v{i}" for i in range(20)]
    for name, value in cells.items():
        fields[AGENT_COLUMNS.index(name)] = value
    return ",".join('"' + f.replace('"', '""') + '"' if any(x in f for x in ',"\n') else f for f in fields)


def table(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_id long, raw_line string")


def reasons(spark, lines):
    return {r["line_id"]: r["reason"] for r in failing_records(table(spark, lines)).collect()}


def test_reasons(spark):
    call = {"tool_name": "t", "call_id": "c", "parameters": {}}
    lines = [
        record(),  # 0 sound
        record() + "\r",  # 1 a final carriage return does not belong to it
        record(agent_response="a\nb, \"c\""),  # 2 line break, comma, quotes
        '"open,' + record(),  # 3
        record().replace("v3", '"v"3'),  # 4 text after the closing quote
        record() + ",more",  # 5
        "a,b",  # 6
        record(trace="[1]"),  # 7
        record(tool_calls=json.dumps([call | {"call_id": 1}])),  # 8
        record(tool_calls=json.dumps([call])),  # 9 sound
        record(metadata="[]"),  # 10
        record(metadata='{"a": NaN}'),  # 11
        record(metadata='{"a": 1,}'),  # 12
        record(trace="all �"),  # 13
        record(trace='see "it", then'),  # 14 other text is valid
        record(metadata="  {}  "),  # 15 blanks aside
        record(trace="{}"),  # 16 an object is no list
        None,  # 17
        "",  # 18
        record(agent_name='a"b'.replace('"', "'")).replace("a'b", 'a"b'),  # 19 a quote inside a bare field
    ]
    assert reasons(spark, lines) == {
        3: "quoting", 4: "quoting", 5: "column_count", 6: "column_count", 7: "invalid_value", 8: "invalid_value", 10: "invalid_value",
        11: "invalid_value", 12: "invalid_value", 13: "invalid_value", 16: "invalid_value", 17: "column_count", 18: "column_count",
    }


def test_first_reason_and_all_errors(spark):
    _, rejected = load_records(table(spark, [record(trace="[1]", metadata="[")]))
    row = rejected.first()
    assert row["reason"] == "invalid_value"
    assert [e["column"] for e in row["errors"]] == ["metadata", "trace"]


def test_clean_and_rejected_part_the_rows(spark):
    lines = [record(), record(), "x", "x", record(user_id="é, \"q\"")]
    clean, rejected = load_records(table(spark, lines))
    assert clean.columns == ["line_id", *AGENT_COLUMNS]
    assert {r["line_id"] for r in clean.collect()} == {0, 1, 4}
    assert {r["line_id"] for r in rejected.collect()} == {2, 3}
    assert clean.where("line_id = 4").first()["user_id"] == 'é, "q"'


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "x", "p", "e"), (None, "x", "p", "e"), (7, record(), "p", "e")], "line_id long, raw_line string, pos string, errors string")
    clean, rejected = load_records(df)
    assert rejected.count() == 1 and clean.count() == 1


def test_empty_table(spark):
    clean, rejected = load_records(table(spark, []))
    assert clean.count() == 0 and rejected.count() == 0


def test_very_long_and_deep(spark):
    deep = "[" * 50_000 + "]" * 50_000
    long = '""' * 200_000
    lines = [record(trace=deep), record(system_prompt="z" * 2_000_000), record().replace("v3", f'"{long}"'), record().replace("v3", f'"{long}')]
    assert reasons(spark, lines) == {0: "invalid_value", 3: "quoting"}


def _parse(line):
    """Character by character, as the rules are stated."""
    line = line.removesuffix("\r")
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, out = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    out, i = out + '"', i + 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    out, i = out + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            out, i = line[i:j], j
        fields.append(out)
        if i >= len(line):
            return fields
        i += 1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='a,"\n\r b', max_size=25), min_size=1, max_size=60))
def test_splitting_equals_a_state_machine(spark, lines):
    df = table(spark, lines)
    clean, rejected = load_records(df, columns=("a", "b", "c"), rules={})
    got = {r["line_id"]: (r["a"], r["b"], r["c"]) for r in clean.collect()}
    bad = {r["line_id"]: r["reason"] for r in rejected.collect()}
    for i, line in enumerate(lines):
        fields = _parse(line)
        if fields is None:
            assert bad[i] == "quoting"
        elif len(fields) != 3:
            assert bad[i] == "column_count"
        else:
            assert got[i] == tuple(fields)
