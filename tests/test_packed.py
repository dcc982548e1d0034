import pytest

from assaykit.operators.packed import explode_packed, lattice_edges, lattice_of, segment, weigh

SCHEMA = "row_id long, tools_available string, tool_calls string, parameters_passed string, tool_call_results string"


def exploded(spark, rows, schema=SCHEMA):
    out = {}
    for r in explode_packed(spark.createDataFrame(rows, schema)).orderBy("row_id", "field", "pos").collect():
        out.setdefault((r["row_id"], r["field"]), []).append((r["pos"], r["value"]))
    for values in out.values():
        assert [p for p, _ in values] == list(range(1, len(values) + 1))
    return {k: [v for _, v in vs] for k, vs in out.items()}


@pytest.mark.parametrize(
    ("field", "text", "values"),
    [
        ("tool_calls", 'a(x="1, 2"); b(), c call', ['a(x="1, 2")', "b()", "c call"]),
        ("tool_calls", '"a(x=""1 ; 2"")" | "b"', ['a(x="1 ; 2")', "b"]),
        ("tool_calls", '"a(x=\\"1 | 2\\")"\tb', ['a(x="1 | 2")', "b"]),
        ("tool_calls", '[{"tool_name": "a", "parameters": {"q": 1}}, {"tool_name": "b"}]', ["a", "b"]),
        ("tool_calls", '["a(\\"x, y\\")", "", null, "b"]', ['a("x, y")', "b"]),
        ("tool_calls", "f(g(1, 2), [3, 4]), h", ["f(g(1, 2), [3, 4])", "h"]),
        ("tool_calls", "f(1, 2", ["f(1", "2"]),
        ("tool_calls", '5" disk, b', ['5" disk', "b"]),
        ("tool_call_results", 'status "a, b" for X; couldn\'t open', ['status "a, b" for X', "couldn't open"]),
        ("tool_call_results", "a; ;b;", ["a", "b"]),
        ("tool_call_results", '[{"result": 3.50}, {"result": "x"}]', ["3.50", "x"]),
        ("tool_call_results", "one value here", ["one value here"]),
        ("tool_call_results", '"" , a', ["a"]),
        ("parameters_passed", '{"a": 1.0, "b": "x y", "c": [1, 2]}', ["a=1.0", "b=x y", 'c=[1, 2]']),
        ("parameters_passed", '{"a": true, "b": null, "c": {"d": 1.50}}', ["a=true", "b=", 'c={"d": 1.5}']),
        ("parameters_passed", 'a="x | y", b=c d', ['a="x | y"', "b=c d"]),
        ("tools_available", '[{"name": "a", "description": "x"}, "b"]', ["a", "b"]),
        ("tools_available", "[a, b]", ["[a, b]"]),
        ("tools_available", "a\nb\r\nc", ["a", "b", "c"]),
        ("tools_available", "   ", []),
    ],
)
def test_pieces(field, text, values):
    assert lattice_of(text, field) == (values, False)


def test_blanks_need_every_piece_to_fit():
    assert lattice_of("a=1 b=2", "parameters_passed") == (["a=1", "b=2"], True)
    assert lattice_of('a="1 2" b=2', "parameters_passed") == (['a="1 2"', "b=2"], True)
    assert lattice_of("a=log line", "parameters_passed") == (["a=log line"], False)
    assert lattice_of("a b, c", "tools_available") == (["a b", "c"], False)
    assert lattice_of("a b", "tool_calls") == (["a b"], False)


def single(field, atoms, counts, total):
    return weigh([(i, j, counts.get(u, 0.0), x) for i, j, u, x in lattice_edges(field, atoms)], total)


def test_lattice_prefers_frequent_units():
    assert single("tools_available", ["mailer", "profiler"], {"mailer": 50.0, "profiler": 40.0}, 500.0)[1]
    expected, alone = single("tools_available", ["see", "the", "manual", "of", "it"], {}, 500.0)
    assert not alone
    assert abs(sum(x for i, j, x in expected if i <= 2 < j) - 1) < 1e-6


def test_unseen_names_do_not_depend_on_the_size_of_the_column():
    for total in (1.0, 1e3, 1e12):
        assert single("tools_available", ["geo_coder", "webFetch"], {}, total)[1]
        assert single("parameters_passed", ["retries=3", "backoff=2"], {}, total)[1]
        assert not single("tools_available", ["see", "the", "manual"], {}, total)[1]


def test_rounds_end_when_the_frequencies_hold_still(spark):
    """Frequencies learned from open lattices decide about others that have no other evidence."""
    choices = spark.createDataFrame([("tools_available", "a", 40, ["mailer", "geo_coder"]), ("tools_available", "b", 1, ["mailer", "see"]), ("tools_available", "c", 3, ["ask", "me"])], "field string, key string, n long, atoms array<string>")
    certain = spark.createDataFrame([("tools_available", "geo_coder", 5.0)], "field string, unit string, c double")
    decided, rounds = segment(choices, certain)
    got = {r["key"]: r["single"] for r in decided.collect()}
    assert got["a"] and not got["c"]
    assert 2 <= rounds <= 20


def test_column_frequencies_decide(spark):
    rows = [(i, "mailer, profiler, web_fetch", None, None, None) for i in range(200)]
    rows += [(1000, "mailer   profiler", None, None, None), (1001, "see the manual of this", None, None, None), (1002, "mailer", None, None, None)]
    got = exploded(spark, rows)
    assert got[1000, "tools_available"] == ["mailer", "profiler"]
    assert (1001, "tools_available") not in got and (1002, "tools_available") not in got


def test_edge_cases(spark):
    assert exploded(spark, []) == {}
    rows = [(1, None, "", " ", "\n"), (2, "a,b", None, None, None), (2, "a,b", None, None, None), (None, None, "x;y", None, None)]
    out = explode_packed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["row_id"] or 0, r["pos"], r["value"]) for r in out) == [(0, 1, "x"), (0, 2, "y"), (2, 1, "a"), (2, 1, "a"), (2, 2, "b"), (2, 2, "b")]
    clash = spark.createDataFrame([(1, "a,b", None, None, None, "f", 3, "v")], SCHEMA + ", field string, pos int, value string")
    assert explode_packed(clash).count() == 2


def test_very_long_fields(spark):
    many = " ".join(f"k{i}=1" for i in range(20_000))
    text = ", ".join(["x" * 50] * 20_000)
    got = exploded(spark, [(1, None, None, many, text)])
    assert len(got[1, "parameters_passed"]) == 20_000 and len(got[1, "tool_call_results"]) == 20_000


def test_values_that_stand_only_beside_blanks(spark):
    """Whatever the size of the table, and however often such a field comes."""
    for n in (10, 1000):
        rows = [(i, "mailer, profiler", None, "limit=1, path=x", None) for i in range(n)]
        rows += [(5000 + i, "geo_coder webFetch", None, "retries=3 backoff=2", None) for i in range(50)]
        rows += [(6000, "sql_runner summarizer", None, "a=1 b=2 c=3", None), (6001, "see the manual of this", None, "a=log line", None)]
        got = exploded(spark, rows)
        for i in (5000, 5049):
            assert got[i, "tools_available"] == ["geo_coder", "webFetch"] and got[i, "parameters_passed"] == ["retries=3", "backoff=2"]
        assert got[6000, "tools_available"] == ["sql_runner", "summarizer"] and got[6000, "parameters_passed"] == ["a=1", "b=2", "c=3"]
        assert (6001, "tools_available") not in got and (6001, "parameters_passed") not in got
