"""Splitting fields that hold several values, keeping their positions.

Every field becomes a lattice over its atoms, what stands between separators; quoted and bracketed spans are
one atom each. Commas, semicolons, bars, tabs and line breaks always separate, so a lattice with them, or of a
JSON list, has one path. Where blanks are the only separators and every atom may be a name or a parameter, the
lattice is open: its edges are all runs of up to MAX_RUN atoms and the whole. Value frequencies of the column
start from the lattices of one path and are refined over the open ones by expectation-maximisation until they
hold still; what a lattice's Viterbi path gives are the field's values.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions import jsonstrict
from assaykit.session import cut, small_side

PACKED_FIELDS = ("tools_available", "tool_calls", "parameters_passed", "tool_call_results")

#: Lattice edges span up to so many atoms, besides the one that spans all.
MAX_RUN = 3
#: Expectation-maximisation ends when no frequency of a field moves by more than this share of all, which a few rounds reach.
TOLERANCE = 1e-4
#: The odds of one character of a value that was not seen, and of such a value: as written like an identifier, or as any other text.
CHAR, NAME_ODDS, TEXT_ODDS = 1 / 64, 1 / 4, 1 / 4096
#: Taken off expected counts; without it every run that occurs once would be as likely as the atoms it is made of.
DISCOUNT = 0.5

_BREAKS = r",;|\t\r\n\v\f\x85\u2028\u2029"
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_NAME = re.compile(r"[^\W\d][\w.:/-]*\Z")
_PARAMETER = re.compile(r"[^\W\d][\w.:-]*=")
#: Names written as no word of prose is: with an underscore, a capital inside, or parts joined by a dot or colon.
_IDENTIFIER = r"^(?:\w*[^\W_]_+[^\W_]\w*|[a-z]{2,}[A-Z]\w*|\w{2,}(?:[.:]\w{2,})+)$"
_NAMES = {"tools_available": ("name", "tool_name"), "tool_calls": ("tool_name", "name"), "tool_call_results": ("result",)}

#: Fields in which blanks may separate -> what a piece must look like for that.
BLANK_FIELDS: dict[str, re.Pattern] = {"tools_available": _NAME, "parameters_passed": _PARAMETER}


def _quote_end(text: str, at: int) -> int:
    """Index after the quote that closes the one at `at`; doubled and backslashed quotes do not close. -1: none does."""
    i = at + 1
    while True:
        j = text.find('"', i)
        if j < 0:
            return -1
        k = j
        while k > i and text[k - 1] == "\\":
            k -= 1
        if (j - k) % 2:
            i = j + 1
        elif text[j + 1 : j + 2] == '"':
            i = j + 2
        else:
            return j + 1


def _scan(text: str, blanks: bool) -> list[str]:
    """Pieces between separators outside quotes and brackets. Quotes and brackets that never close are ordinary characters."""
    if not blanks and not re.search(r'["()\[\]{}]', text):
        return re.split(f"[{_BREAKS}]", text)
    pairs, stack, quotes, i = {}, [], {}, 0
    for m in re.finditer(r'["()\[\]{}]', text):  # what closes what
        if m.start() < i:
            continue
        c = m.group()
        if c == '"':
            if (e := _quote_end(text, m.start())) > 0:
                quotes[m.start()] = i = e
        elif c in _CLOSE:
            stack.append(m.start())
        else:
            for d in range(len(stack) - 1, -1, -1):
                if _CLOSE[text[stack[d]]] == c:
                    pairs[stack[d]] = m.start() + 1
                    del stack[d:]
                    break
    cut_at = re.compile(r'["(\[{]|[' + _BREAKS + "]" + (r"|[^\S\t\r\n]" if blanks else ""))
    pieces, start, i = [], 0, 0
    while m := cut_at.search(text, i):
        c = m.group()
        if c in '"([{':
            i = (quotes if c == '"' else pairs).get(m.start(), m.end())
        else:
            pieces.append(text[start : m.start()])
            start = i = m.end()
    return [*pieces, text[start:]]


def _unquote(piece: str) -> str:
    piece = piece.strip()
    if len(piece) > 1 and piece[0] == '"' and _quote_end(piece, 0) == len(piece):
        piece = re.sub(r'""|\\"', '"', piece[1:-1]).strip()
    return piece


def _written(raw, x) -> str:
    """A JSON value as text: strings as they are, numbers as written, nulls as nothing, the rest as JSON. raw: x with its numbers as text."""
    if x is None:
        return ""
    if isinstance(raw, str):
        return raw.strip()
    return json.dumps(x, ensure_ascii=False)


def _from_json(text: str, field: str) -> list[str] | None:
    """The values of a JSON list, or of an object of parameters; None if the text is neither."""
    if text[:1] not in ("[", "{"):
        return None
    try:
        raw, x = jsonstrict.loads(text, raw_numbers=True), jsonstrict.loads(text)
    except jsonstrict.Invalid:
        return None
    if isinstance(x, dict):
        return [f"{k}={_written(raw[k], v)}" for k, v in x.items()] if field == "parameters_passed" else [text]
    values = []
    for r, e in zip(raw, x, strict=True):
        if isinstance(e, dict):
            key = next((k for k in (*_NAMES.get(field, ()), "name", "tool_name", "result") if k in e), None)
            r, e = (r, e) if key is None else (r[key], e[key])
        values.append(_written(r, e))
    return values


def lattice_of(text: str | None, field: str) -> tuple[list[str], bool]:
    """(atoms, open): with one path the atoms are the values; an open lattice may join atoms that blanks separate."""
    if not isinstance(text, str) or not (text := text.strip()):
        return [], False
    values = _from_json(text, field)
    if values is not None:
        return [v for v in values if v], False
    pieces = _scan(text, False)
    values = [v for v in map(_unquote, pieces) if v]
    shape = BLANK_FIELDS.get(field)
    if shape is None or len(pieces) > 1 or len(values) != 1 or not re.search(r"\s", text):
        return values, False
    atoms = [v for v in map(_unquote, _scan(text, True)) if v]
    return (atoms, True) if len(atoms) > 1 and all(map(shape.match, atoms)) else (values, False)


def unit_of(value: str, field: str) -> str:
    """What the frequencies are counted of: a parameter's key, else the value."""
    return value.partition("=")[0] if field == "parameters_passed" else value


_LATTICE = T.StructType([T.StructField("atoms", T.ArrayType(T.StringType())), T.StructField("open", T.BooleanType())])


@F.pandas_udf(_LATTICE)
def _lattice(field: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lattice_of(t, f) for f, t in zip(field, text, strict=True)], columns=["atoms", "open"])


def _runs(n: int) -> Iterator[tuple[int, int]]:
    for i in range(n):
        for j in range(i + 1, min(n, i + MAX_RUN) + 1):
            yield i, j
    if n > MAX_RUN:
        yield 0, n


def lattice_edges(field: str, atoms: list[str]) -> list[tuple[int, int, str, float]]:
    """(from, to, unit, log odds of the unit if it was never seen) of every edge. A run of atoms is a value that holds blanks."""
    edges = []
    for i, j in _runs(len(atoms)):
        unit = unit_of(atoms[i], field) if j == i + 1 else " ".join(atoms[i:j])
        named = j == i + 1 and (field == "parameters_passed" or re.match(_IDENTIFIER, unit) is not None)
        edges.append((i, j, unit, math.log(NAME_ODDS if named else TEXT_ODDS) + len(unit) * math.log(CHAR)))
    return edges


def weigh(edges: list[tuple[int, int, float, float]], total: float) -> tuple[list[tuple[int, int, float]], bool]:
    """(expected uses of each edge by forward-backward, does the Viterbi path take single atoms only?).

    edges: (from, to, count of the unit, log odds if it was never seen); total: all counts of the field.
    """
    n = max(j for _, j, _, _ in edges)
    cost = {(i, j): math.log(c / (total + 1)) if c > 0 else odds for i, j, c, odds in edges}
    into: dict[int, list[int]] = {}
    out_of: dict[int, list[int]] = {}
    for i, j in sorted(cost):
        into.setdefault(j, []).append(i)
        out_of.setdefault(i, []).append(j)
    fwd, best, back = {0: 0.0}, {0: 0.0}, {}
    for j in range(1, n + 1):
        terms = [fwd[i] + cost[i, j] for i in into[j]]
        top = max(terms)
        fwd[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        best[j], back[j] = max((best[i] + cost[i, j], i) for i in into[j])
    bwd = {n: 0.0}
    for i in range(n - 1, -1, -1):
        terms = [bwd[j] + cost[i, j] for j in out_of[i]]
        top = max(terms)
        bwd[i] = top + math.log(sum(math.exp(t - top) for t in terms))
    expected = [(i, j, math.exp(min(0.0, fwd[i] + c + bwd[j] - fwd[n]))) for (i, j), c in cost.items()]
    return expected, all(back[j] == j - 1 for j in range(1, n + 1))


def _weigher(totals: dict[str, float]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, field, edges in zip(batch["key"], batch["field"], batch["edges"], strict=True):
                units = {(e["i"], e["j"]): e["unit"] for e in edges}
                expected, single = weigh([(e["i"], e["j"], e["c"], e["odds"]) for e in edges], totals.get(field, 0.0))
                out.append((field, key, single, [(units[i, j], x) for i, j, x in expected if x > 1e-6]))
            yield pd.DataFrame(out, columns=["field", "key", "single", "expected"])

    return run


def segment(choices: DataFrame, certain: DataFrame) -> tuple[DataFrame, int]:
    """((field, key, single), rounds): does the Viterbi path split an open lattice at all blanks? And the rounds that it took.

    choices: (field, key, n, atoms), distinct; certain: (field, unit, c), the counts of the lattices of one path.
    Joins are by unit; the frequency table is broadcast only if it was counted to be small. Only units that an
    open lattice has are carried through the rounds.
    """
    edge = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("unit", T.StringType()), T.StructField("odds", T.DoubleType())]))

    @F.pandas_udf(edge)
    def edges(field: pd.Series, atoms: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j, "unit": u, "odds": x} for i, j, u, x in lattice_edges(f, list(a))] for f, a in zip(field, atoms, strict=True)])

    sizes = cut(choices.select("field", "key", "n"))
    lattice = cut(choices.select("field", "key", F.inline(edges("field", "atoms"))))
    sums = certain.groupBy("field").agg(F.sum("c").alias("t"))
    fixed = {r["field"]: float(r["t"]) for r in sums.collect()}  # one row per field
    known = cut(certain.join(lattice.select("field", "unit").distinct(), ["field", "unit"], "left_semi"))
    counts, added, rounds = known, dict.fromkeys(fixed, 0.0), 0
    while True:
        totals = {f: fixed.get(f, 0.0) + added.get(f, 0.0) for f in {*fixed, *added}}
        weighed = (
            lattice.join(small_side(counts), ["field", "unit"], "left")
            .groupBy("field", "key")
            .agg(F.collect_list(F.struct("i", "j", "unit", "odds", F.coalesce("c", F.lit(0.0)).alias("c"))).alias("edges"))
        )
        result = cut(weighed.mapInPandas(_weigher(totals), "field string, key string, single boolean, expected array<struct<unit: string, x: double>>"))
        rounds += 1
        uses = result.join(sizes, ["field", "key"]).select("field", "n", F.inline("expected")).groupBy("field", "unit").agg((F.sum(F.col("x") * F.col("n")) - DISCOUNT).alias("c")).where("c > 0")
        new = cut(known.unionByName(uses).groupBy("field", "unit").agg(F.sum("c").alias("c")))
        moved = new.join(counts.withColumnRenamed("c", "old"), ["field", "unit"], "full").groupBy("field").agg(
            F.max(F.abs(F.coalesce("c", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("most"), F.coalesce(F.sum("c"), F.lit(0.0)).alias("t")
        )
        change = {r["field"]: (float(r["most"]), float(r["t"])) for r in moved.collect()}  # one row per field
        before = {r["field"]: float(r["t"]) for r in known.groupBy("field").agg(F.sum("c").alias("t")).collect()} if rounds == 1 else before
        counts, added = new, {f: t - before.get(f, 0.0) for f, (_, t) in change.items()}
        if all(most <= TOLERANCE * max(1.0, fixed.get(f, 0.0) + t) for f, (most, t) in change.items()):
            return result.select("field", "key", "single"), rounds


def explode_packed(df: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = PACKED_FIELDS) -> DataFrame:
    """(id_col, field, pos, value): all values of every field that holds two or more, counted from 1.

    Fields that are null, blank, or hold one value give no rows, nor do empty pieces. Repeated rows are
    split alike. Ids may be null or repeated. Other columns are ignored, whatever their names.
    """
    long = df.select(
        F.col(f"`{id_col}`").alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields]))
    ).where("trim(text) <> ''")
    # One evaluation; fields of one value are kept where they tell frequencies.
    parts = long.select("id", "field", _lattice("field", "text").alias("p")).select("id", "field", "p.*")
    parts = cut(parts.where((F.size("atoms") > 1) | F.col("field").isin(list(BLANK_FIELDS)))).withColumn("key", F.when(F.col("open"), F.md5(F.array_join("atoms", " "))))
    choices = cut(parts.where("open").groupBy("field", "key").agg(F.count(F.lit(1)).alias("n"), F.any_value("atoms").alias("atoms")))
    unit = F.when(F.col("field") == "parameters_passed", F.substring_index("v", "=", 1)).otherwise(F.col("v"))
    certain = cut(
        parts.where(F.col("field").isin(list(BLANK_FIELDS)) & ~F.col("open"))
        .select("field", F.explode("atoms").alias("v"))
        .groupBy("field", unit.alias("unit"))
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    decided = segment(choices, certain)[0]
    split = parts.where("not open").select("id", "field", "atoms").unionByName(
        parts.where("open").join(small_side(decided.where("single").select("field", "key")), ["field", "key"], "left_semi").select("id", "field", "atoms")
    )
    return split.where("size(atoms) > 1").select(F.col("id").alias(id_col), "field", F.posexplode("atoms").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)
