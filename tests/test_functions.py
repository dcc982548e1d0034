import pytest
from pyspark.sql import functions as F

from assaykit.functions import jsonstrict, responses, text, vectors


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("response", "answer"),
    [
        ("Answer: C", "C"), ("answer:  yes it is", "yes"), ("I say the correct answer is b now", "b"), ("so **D. all** then", "D"), (" c. ", "c"), ("x\nB: this", "B"),
        ("one\ntwo (C)\nend", "C"), ("nothing here", "nothing"), ("", ""), ("   ", ""), (None, None), ("this is a test", "a"), ("line\n" * 9 + "so B\nx\ny\nz", "B"),
    ],
)
def test_answer_ladder(spark, response, answer):
    assert one(spark, text.extract_answer(F.col("r")), r=response) == answer


def test_exact_match_order_of_steps(spark):
    assert one(spark, text.exact_match(F.col("a"), F.col("b")), a="\n x \t", b="x") == 1.0
    assert one(spark, text.exact_match(F.col("a"), F.col("b"), normalize_whitespace=True), a="x\n\ny", b=" x y") == 1.0
    assert one(spark, text.exact_match(F.col("a"), F.col("b"), strip_whitespace=False), a=" x", b="x") == 0.0
    assert one(spark, text.exact_match(F.col("a"), F.col("b")), a=None, b="x") == 0.0


def test_choices(spark):
    assert one(spark, text.choice_of(F.col("a"), F.col("c")), a=" b ", c=["p", "q"]) == "q"
    assert one(spark, text.choice_of(F.col("a"), F.col("c")), a="D", c=["p", "q"]) is None
    assert one(spark, text.choice_index(F.col("a"), F.col("c")), a="Big cat", c=["dog", "cat", "big cat"]) == 2
    assert one(spark, text.choice_index(F.col("a"), F.col("c")), a="Big cat", c=["dog", "cat"]) == 1
    assert one(spark, text.choice_index(F.col("a"), F.col("c")), a="x", c=["dog", "cat"]) is None


def test_f1_is_over_sets(spark):
    s = one(spark, text.token_f1(F.col("a"), F.col("b")), a="the the cat", b="the dog")
    assert (s["precision"], s["recall"], s["f1"]) == (0.5, 0.5, 0.5)
    assert one(spark, text.token_f1(F.col("a"), F.col("b")), a=None, b="x")["f1"] == 0.0
    assert one(spark, text.token_f1(F.col("a"), F.col("b")), a="Élan", b="élan")["f1"] == 1.0


def test_splitters(spark):
    assert one(spark, text.numbered_claims(F.col("t")), t=" 1. a\n11. b\n- c\n* \nplain\n10. d") == ["a", "1. b", "c", "d"] or one(spark, text.numbered_claims(F.col("t")), t="11. b") == ["11. b"]
    assert one(spark, text.numbered_questions(F.col("t")), t="1. a?\n2. b\n- c?") == ["a?", "c?"]
    assert one(spark, text.sentence_claims(F.col("t"), 10, 1), t="short. long enough one. long enough two.") == ["long enough one"]
    assert one(spark, text.numbered_items(F.col("t")), t="None") == []
    assert one(spark, text.listed_violations(F.col("t")), t="YES\na\nNo b\n\nc") == ["a", "c"]
    assert one(spark, text.listed_violations(F.col("t")), t="no, fine\nx") == []
    assert one(spark, text.context_chunks(F.col("t")), t="too short. all of it") == ["too short. all of it"]
    assert one(spark, text.pairs(F.col("c")), c=["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert one(spark, text.pairs(F.col("c")), c=["a"]) == []


@pytest.mark.parametrize(("value", "flag"), [(" ON", True), ("0", False), ("No", False), ("maybe", None), (None, None), ("", None)])
def test_truthy(spark, value, flag):
    assert one(spark, text.truthy(F.col("v")), v=value) is flag


@pytest.mark.parametrize(
    ("f", "response", "score"),
    [
        (responses.rating_or_last, "Rating: 12 or 3", 12.0), (responses.rating_or_last, "rating: 4 then 2", 2.0), (responses.rating_or_last, "none", 3.0),
        (responses.rating_or_first, "7 or 4", 4.0), (responses.rating_of_ten, "Rating: 99", 10.0), (responses.rating_of_ten, '{"rating": "x"}', 5.0),
        (responses.panel_score, '```json\n{"score": 3, "reasoning": "r"}\n```', 0.5), (responses.panel_score, '{"score": 6, "reasoning": "r"}', 0.0), (responses.panel_score, '{"score": 3}', 0.0),
        (responses.criteria_score, "**Score:** 4/5", 0.75), (responses.criteria_score, "I give 2 and then 3", 0.5), (responses.criteria_score, "none", 0.0), (responses.criteria_score, "**Score:** 9", 1.0),
    ],
)
def test_scores(spark, f, response, score):
    assert one(spark, f(F.col("r")), r=response) == score


@pytest.mark.parametrize(
    ("response", "score"),
    [('{"score": 4, "reasoning": "r"}', 4.0), ('x {"score": 2.5} y', 2.5), ('"score": 7, "reasoning": "cut', 7.0), ("8", 8.0), ("about 6", 6.0), ("none", 1.0), ("[1]", 1.0), ("", 1.0)],
)
def test_agent_scores(spark, response, score):
    assert one(spark, responses.agent_score(F.col("r")), r=response)["score"] == score


def test_partial_verdicts(spark):
    args = ("SUPPORTED", "PARTIALLY_SUPPORTED", "NOT_SUPPORTED")
    assert one(spark, responses.verdict_weight(F.col("r"), *args), r="Partially_supported") == 0.5
    assert one(spark, responses.verdict_weight(F.col("r"), *args, True), r="Partially_supported") == 1.0
    assert one(spark, responses.verdict_weight(F.col("r"), *args), r="NOT_SUPPORTED") == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r["x"] for r in df.select(vectors.similarity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert [round(x, 9) for x in got] == [0.5, 1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("bad", ["[1,]", "{'a': 1}", "NaN", "[1] x", "", '{"a" 1}', "[01]", '["\t"]'])
def test_strict_json(bad):
    with pytest.raises(jsonstrict.Invalid):
        jsonstrict.loads(bad)
    with pytest.raises((jsonstrict.Invalid, IndexError)):
        jsonstrict._iterative(bad, float)


def test_strict_json_of_any_depth():
    assert jsonstrict.loads("[" * 100_000 + "]" * 100_000)
    assert jsonstrict.loads('{"a": 1.50}', raw_numbers=True) == {"a": "1.50"}
