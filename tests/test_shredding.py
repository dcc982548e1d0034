import json

from assaykit import schemas
from assaykit.operators.shredding import adjacency_of, attribute_table, json_adjacency, json_objects, objects_of, pivot_entities, span_table, trace_table

TRACES = "delivery_id long, trace_id string, project string, environment string, spans array<struct<span_id: string, trace_id: string, parent_span_id: string, name: string, attributes: map<string, string>>>"


def traces(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TRACES)


def payloads(spark, bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "payload_id long, body string")


def found(spark, rows=(), bodies=()):
    return {tuple(r) for r in span_table(traces(spark, list(rows)), payloads(spark, list(bodies))).collect()}


def span(i, parent=None, op=None):
    return (i, "other", parent, "n", None if op is None else {"operation.type": op})


def test_deliveries_merge(spark):
    rows = [("t", None, None, [span("a", "0000-0000"), span("b", None)]), ("t", None, None, [span("b", "a", "query"), span("a", " "), span("b", "a", "query"), None])]
    assert found(spark, rows) == {("t", "a", "", ""), ("t", "b", "a", "query")}


def test_missing_spans_and_ids(spark):
    assert found(spark, [("t", None, None, None), ("t", None, None, []), (None, None, None, [span("x", "gone")]), ("t", None, None, [span(None, "p")])]) == {("", "x", "gone", "")}


def test_payload_forms(spark):
    nested = {"span_id": "c1", "attributes": {"operation": {"type": "mutation"}}, "children": [{"span_id": "c2", "attributes": [{"key": "operation.type", "value": {"stringValue": "Query"}}]}]}
    bodies = [
        {"trace_id": "t1", "spans": [nested, {"span_id": "f", "trace_id": "zzz", "parent_span_id": "c2", "attributes": {"operation.type": "x"}}]},
        {"data": {"traces": [{"trace_id": "t2", "resource_spans": [{"scopes": [{"spans": [{"span_id": "g", "parent_span_id": None, "attributes": None}]}]}]}]}, "cursor": None},
        {"trace": {"trace_id": "t3", "spans": []}, "received_by": "x"},
        [{"trace_id": "t4", "spans": [{"span_id": "h", "children": [{"span_id": "i", "parent_span_id": "gone"}]}]}],
        {"spans": [{"span_id": "j", "trace_id": "t5"}]},
        None, "", "not json", '{"trace_id": "t6", "spans": [{"span_id": "k"}]', "17",
    ]
    assert found(spark, [], bodies + bodies[:1]) == {
        ("t1", "c1", "", "mutation"), ("t1", "c2", "c1", "Query"), ("t1", "f", "c2", "x"), ("t2", "g", "", ""), ("t4", "h", "", ""), ("t4", "i", "gone", ""), ("t5", "j", "", ""),
    }


def test_very_deep_payload(spark):
    deep = '{"trace_id": "t", "spans": [' + '{"span_id": "s", "children": [' * 3000 + "]}" * 3000 + "]}"
    assert found(spark, [], [deep]) == {("t", "s", "s", "")}


def test_adjacency_round_trip(spark):
    """An object rebuilt from its adjacency rows is the object that was shredded."""
    value = {"a": 1, "b": [{"c": "x"}, {"c": None, "d": [1, [2, "é"]]}], "e": {}, "f": []}
    rows = list(adjacency_of(value, "span_id", "trace_id", ()))
    kids = {}
    for r in rows:
        kids.setdefault(r[2], []).append(r)

    def build(r):
        _, node, _, _, _, kind, scalar = r
        if kind == "object":
            return {k[3]: build(k) for k in sorted(kids.get(node, []), key=lambda k: k[4])}
        if kind == "array":
            return [build(k) for k in sorted(kids.get(node, []), key=lambda k: k[4])]
        return scalar

    root = next(r for r in rows if r[2] == -1)
    assert build(root) == {"a": "1", "b": [{"c": "x"}, {"c": None, "d": ["1", ["2", "é"]]}], "e": {}, "f": []}
    assert len({r[1] for r in rows}) == len(rows)


def test_pivot_of_any_entity(spark):
    bodies = payloads(spark, [{"id": "r", "items": [{"sku": "1", "n": 2}, {"n": 3}]}])
    out = pivot_entities(json_objects(bodies, "body", id_key="sku", root_key="id"), {"sku": "sku", "n": "n"}, "sku").collect()
    assert [(r["root"], r["sku"], r["n"]) for r in out] == [("r", "1", "2")]
    flat = json_adjacency(bodies, "payload_id", "body", id_key="sku", root_key="id").collect()
    assert sorted((r["label"], r["scalar"]) for r in flat if r["kind"] == "scalar") == [("id", "r"), ("n", "2"), ("n", "3"), ("sku", "1")]


def test_children_stand_beside_their_object():
    value = {"a": 1, "b": [{"c": "x", "d": [7, {"e": 2}]}, 5], "f": {"g": None}}
    flat, beside = list(adjacency_of(value, "id", "root", ())), list(objects_of(value, "id", "root", (), None))
    nodes = {r[1] for r in flat if r[5] == "object"}
    assert [(o[1], *c) for o in beside for c in o[5]] == [(r[2], r[3], r[4], r[6]) for r in flat if r[5] == "scalar" and r[2] in nodes]


def test_null_and_repeated_delivery_ids(spark):
    """Eight different spans of two deliveries stay eight, whatever the ids of the deliveries."""
    halves = [[span(f"a{i}") for i in range(4)], [span(f"b{i}") for i in range(4)]]
    for ids in ((None, None), (1, 1), (1, 2)):
        t = spark.createDataFrame([(d, "t", None, None, x) for d, x in zip(ids, halves, strict=True)], TRACES)
        p = spark.createDataFrame([(None, json.dumps({"trace_id": "u", "spans": [{"span_id": f"c{i}{j}"} for j in range(4)]})) for i in range(2)], "payload_id long, body string")
        assert {r["span_id"] for r in span_table(t, p).collect()} == {f"{x}{i}" for x in "ab" for i in range(4)} | {f"c{i}{j}" for i in range(2) for j in range(4)}


def test_attributes_and_traces(spark):
    t = traces(spark, [("t", "p", None, [span("a", None, "q")]), ("t", "q", "e", [span("a", None, "q")])])
    p = payloads(spark, [{"trace_id": "u", "project": "x", "spans": [{"span_id": "b", "attributes": {"user": {"id": 5}, "flag": True}}]}])
    assert {tuple(r) for r in attribute_table(t, p).collect()} == {("t", "a", "operation.type", "q"), ("u", "b", "user.id", "5"), ("u", "b", "flag", "true")}
    assert {tuple(r) for r in trace_table(t, p).collect()} == {("t", "q", "e", 2), ("u", "x", None, 1)}


def test_clashing_columns(spark):
    t = traces(spark, [("t", None, None, [span("a")])]).selectExpr("*", "1 as doc", "2 as node", "'x' as label", "'y' as scalar", "'z' as root")
    p = payloads(spark, []).selectExpr("*", "1 as doc", "'x' as label")
    assert span_table(t, p).count() == 1


def test_schema_strings(spark):
    for name in ("SAMPLE", "RAG_SAMPLE", "STAGE", "REQUEST", "TRACE", "TRAJECTORY", "VOTE"):
        spark.createDataFrame([], getattr(schemas, name))
