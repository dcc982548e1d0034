"""Shredding nested records into flat entity tables through an adjacency table.

Every record becomes nodes with parent, label, ordinal and scalar. The scalar children of an object node
are kept beside it, as an array of (label, ordinal, scalar): they stand in the same record, so the join
of object nodes with their scalar children and the pivot into the columns of an entity table are a
projection of one row. Nothing is shuffled for it and no record needs a key; ids of records may be null
or repeated.

Two builders make the nodes: json_objects reads JSON text of any depth, typed_objects takes an array of
structs and the labels asked for, which Catalyst prunes down to the scan. json_adjacency gives the same
nodes as flat rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import jsonstrict

ADJACENCY = "doc bigint, root string, node int, parent int, label string, ordinal int, kind string, scalar string"
OBJECTS = "root string, node int, parent int, label string, ordinal int, children array<struct<label: string, ordinal: int, scalar: string>>"

#: Rows that are handed on at once, however many a batch of records makes.
ROWS = 5_000

#: Label under which a nested object's link to the entity around it is stored.
ENCLOSING = "@enclosing"

_KEYS = ("key", "name", "k")
_WRAPPED = ("stringValue", "intValue", "doubleValue", "boolValue", "value")


def _text(x) -> str | None:
    if x is None or isinstance(x, str):
        return x
    return ("true" if x else "false") if isinstance(x, bool) else json.dumps(x, ensure_ascii=False)


def _flat(obj, at: str = "") -> Iterator[tuple[str, str | None]]:
    """Scalars below an attribute holder by dotted path; key/value lists are objects written as lists."""
    stack = [(at, obj)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict):
            stack += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(x.items())]
        elif isinstance(x, list) and x and all(isinstance(e, dict) and isinstance(e.get("key"), str) for e in x):
            for e in reversed(x):
                v = e.get("value")
                if isinstance(v, dict) and len(v) == 1 and next(iter(v)) in _WRAPPED:
                    v = next(iter(v.values()))
                stack.append((f"{path}.{e['key']}" if path else e["key"], v))
        elif isinstance(x, list):
            stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
        else:
            yield path, _text(x)


def adjacency_of(value, id_key: str, root_key: str, holders: tuple[str, ...]):
    """Yield (root, node, parent, label, ordinal, kind, scalar) of one parsed record, depth first, without recursion.

    root is the id of the enclosing root entity: the nearest object around that has root_key but no
    id_key; failing that, the nearest object around or the object itself that has root_key.
    Objects under a label in `holders` hold attributes: their scalars become children of the owner,
    labelled holder.path. An entity inside another entity gets a scalar child ENCLOSING with its id.
    """
    n = 0
    # (value, parent node, label, ordinal, root id, weak root id, enclosing entity's id)
    stack = [(value, -1, "$", 0, None, None, None)]
    while stack:
        x, parent, label, ordinal, root, weak, inside = stack.pop()
        node, n = n, n + 1
        if isinstance(x, dict):
            entity = x.get(id_key) is not None
            own = x.get(root_key)
            if own is not None and not entity:
                root = _text(own)
            elif own is not None and weak is None:
                weak = _text(own)
            at = root if root is not None else weak
            yield at, node, parent, label, ordinal, "object", None
            if entity and inside is not None:
                yield at, n, node, ENCLOSING, 0, "scalar", inside
                n += 1
            deeper = _text(x[id_key]) if entity else inside
            later = []
            for i, (k, v) in enumerate(x.items()):
                if k in holders:
                    for path, scalar in _flat(v):
                        yield at, n, node, f"{k}.{path}" if path else k, i, "scalar", scalar
                        n += 1
                elif isinstance(v, (dict, list)):
                    later.append((v, node, str(k), i, root, weak, deeper))
                else:
                    yield at, n, node, str(k), i, "scalar", _text(v)
                    n += 1
            stack += reversed(later)
        elif isinstance(x, list):
            at = root if root is not None else weak
            yield at, node, parent, label, ordinal, "array", None
            stack += [(v, node, label, i, root, weak, inside) for i, v in reversed(list(enumerate(x)))]
        else:
            yield root if root is not None else weak, node, parent, label, ordinal, "scalar", _text(x)


def _parse(body) -> object:
    """The JSON value of a text; None if it is null, empty or not JSON."""
    try:
        return jsonstrict.loads(body) if isinstance(body, str) else None
    except jsonstrict.Invalid:
        return None


def objects_of(value, id_key: str, root_key: str, holders: tuple[str, ...], labels: tuple[str, ...] | None):
    """Yield (root, node, parent, label, ordinal, children) of every object: adjacency_of with scalar children beside their object.

    labels: only children so labelled; None takes all.
    """
    current = None
    for root, node, parent, label, ordinal, kind, scalar in adjacency_of(value, id_key, root_key, holders):
        if kind == "object":
            if current is not None:
                yield current
            current = (root, node, parent, label, ordinal, [])
        elif kind == "scalar" and current is not None and parent == current[1] and (labels is None or label in labels):
            current[5].append((label, ordinal, scalar))
    if current is not None:
        yield current


def _in_parts(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) == ROWS:
            yield pd.DataFrame(part, columns=columns)
            part = []
    yield pd.DataFrame(part, columns=columns)


def json_adjacency(df: DataFrame, doc_col: str, body_col: str, id_key: str = "span_id", root_key: str = "trace_id", holders: tuple[str, ...] = ("attributes",)) -> DataFrame:
    """Flat adjacency rows (ADJACENCY) of JSON text; text that is null, empty or not JSON gives none."""

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = ((doc, _parse(body)) for doc, body in zip(batch["doc"], batch["body"], strict=True))
            rows = ((doc, *r) for doc, x in parsed if isinstance(x, (dict, list)) for r in adjacency_of(x, id_key, root_key, holders))
            yield from _in_parts(rows, ["doc", "root", "node", "parent", "label", "ordinal", "kind", "scalar"])

    return df.select(F.col(f"`{doc_col}`").cast("bigint").alias("doc"), F.col(f"`{body_col}`").cast("string").alias("body")).mapInPandas(shred, ADJACENCY)


def json_objects(
    df: DataFrame, body_col: str, id_key: str = "span_id", root_key: str = "trace_id", holders: tuple[str, ...] = ("attributes",), labels: tuple[str, ...] | None = None,
) -> DataFrame:
    """Object nodes (OBJECTS) of JSON text; text that is null, empty or not JSON gives none. labels: only children so labelled."""

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (r for x in map(_parse, batch["body"]) if isinstance(x, (dict, list)) for r in objects_of(x, id_key, root_key, holders, labels))
            yield from _in_parts(rows, ["root", "node", "parent", "label", "ordinal", "children"])

    return df.select(F.col(f"`{body_col}`").cast("string").alias("body")).mapInPandas(shred, OBJECTS)


def typed_objects(df: DataFrame, root_col: str, array_col: str, scalars: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Object nodes (OBJECTS) of an array of structs: one for each element, with a scalar child per label.

    scalars: label -> (field, key in the field if it is a map). The record itself is node 0. Fields are taken
    out of the array before it is exploded, so that the scan reads no others. Null elements have null children.
    """

    def column(field: str, key: str | None) -> Column:
        values = F.col(f"`{array_col}`.`{field}`")
        return values if key is None else F.transform(values, lambda m: F.try_element_at(m, F.lit(key)))

    zipped = F.arrays_zip(*[column(field, key).alias(f"c{i}") for i, (field, key) in enumerate(scalars.values())])
    elements = df.select(F.col(f"`{root_col}`").cast("string").alias("root"), F.posexplode(zipped).alias("at", "e"))
    child = [F.struct(F.lit(label).alias("label"), F.lit(i).alias("ordinal"), F.col(f"e.c{i}").cast("string").alias("scalar")) for i, label in enumerate(scalars)]
    return elements.select(
        "root", (F.col("at") + 1).alias("node"), F.lit(0).alias("parent"), F.lit(array_col).alias("label"), F.col("at").alias("ordinal"), F.array(*child).alias("children")
    )


def pivot_entities(objects: DataFrame, columns: dict[str, str], key: str) -> DataFrame:
    """Pivot object nodes with their scalar children: one row per object that has a `key` child.

    columns: output column -> label. Several children of one label give the greatest, nulls aside.
    """

    def pick(label: str) -> Column:
        return F.array_max(F.transform(F.filter("children", lambda c: c["label"] == label), lambda c: c["scalar"]))

    return objects.select("root", "node", *[pick(label).alias(c) for c, label in columns.items()]).where(F.col(key).isNotNull())


def _no_id(c: Column) -> Column:
    """An id, or null where it says that there is none: null, blanks, or zeros only."""
    return F.when(~F.trim(c).rlike(r"\A[0-]*\z"), c)


SPAN_LABELS = {"span_id": "span_id", "parent_span_id": "parent_span_id", "operation_type": "attributes.operation.type", "enclosing": ENCLOSING}


def span_objects(traces: DataFrame, payloads: DataFrame) -> DataFrame:
    """Object nodes of the spans of both tables, with the labels that SPAN_LABELS pivots."""
    typed = typed_objects(
        traces, "trace_id", "spans", {"span_id": ("span_id", None), "parent_span_id": ("parent_span_id", None), "attributes.operation.type": ("attributes", "operation.type")}
    )
    return typed.unionByName(json_objects(payloads, "body", labels=tuple(SPAN_LABELS.values())))


def span_table(traces: DataFrame, payloads: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent_span_id, operation_type): every span once, however often delivered.

    The parent is the recorded one, else the span that encloses it; '' where there is none (null, blank,
    or zeros only). Where deliveries differ the greatest non-empty value holds, so the result does not
    depend on order. A span without trace has trace_id ''; spans without id are no rows. Ids of deliveries
    and payloads are not read, so they may be null or repeated. Empty tables give an empty table; other
    columns are ignored.
    """
    spans = pivot_entities(span_objects(traces, payloads), SPAN_LABELS, "span_id")
    parent = F.coalesce(_no_id(F.col("parent_span_id")), _no_id(F.col("enclosing")), F.lit(""))
    return (
        spans.select(F.coalesce("root", F.lit("")).alias("trace_id"), "span_id", parent.alias("p"), F.coalesce("operation_type", F.lit("")).alias("o"))
        .groupBy("trace_id", "span_id")
        .agg(F.max("p").alias("parent_span_id"), F.max("o").alias("operation_type"))
    )


def attribute_table(traces: DataFrame, payloads: DataFrame) -> DataFrame:
    """(trace_id, span_id, key, value): the attributes of every span, each once; deliveries with another value give another row.

    A span's attributes travel as one array, so trace and span id are shuffled once per span; equal
    deliveries are dropped before the shuffle. Only the differing attribute sets of one span meet.
    """
    sets = (
        traces.select(F.col("trace_id").cast("string").alias("root"), F.explode(F.arrays_zip(F.col("spans.span_id").alias("span_id"), F.col("spans.attributes").alias("attributes"))).alias("e"))
        .select("root", "e.span_id", F.map_entries("e.attributes").alias("a"))
    )
    children = json_objects(payloads, "body")
    own = F.transform(F.filter("children", lambda c: c["label"].startswith("attributes.")), lambda c: F.struct(F.substring(c["label"], 12, 1 << 30).alias("key"), c["scalar"].alias("value")))
    text = children.select("root", F.array_max(F.transform(F.filter("children", lambda c: c["label"] == "span_id"), lambda c: c["scalar"])).alias("span_id"), own.alias("a"))
    met = sets.unionByName(text).where("span_id is not null and size(a) > 0").groupBy(F.coalesce("root", F.lit("")).alias("trace_id"), "span_id").agg(F.collect_set("a").alias("a"))
    return met.select("trace_id", "span_id", F.inline(F.array_distinct(F.flatten("a"))))


def trace_table(traces: DataFrame, payloads: DataFrame) -> DataFrame:
    """(trace_id, project, environment, deliveries): one row per trace of both tables, the greatest spelling of each."""
    text = pivot_entities(json_objects(payloads, "body", labels=("trace_id", "project", "environment", "span_id")), {"trace_id": "trace_id", "project": "project", "environment": "environment", "span": "span_id"}, "trace_id")
    both = traces.select("trace_id", "project", "environment").unionByName(text.where("span is null").select("trace_id", "project", "environment"))
    return both.where("trace_id is not null").groupBy("trace_id").agg(F.max("project").alias("project"), F.max("environment").alias("environment"), F.count(F.lit(1)).alias("deliveries"))
