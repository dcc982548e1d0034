import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import mixing
from assaykit.llm.mixing import TOKENIZER, fit_rates, mix, source_key, with_tokens

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer files")

DOCS = "doc_id long, text string, source string"
TARGETS = "mix_name string, source string, target_share double, max_repeats int, size_ratio double"
VOCAB = {"code": "def return import class self print", "news": "minister said market report police city", "chat": "hello thanks okay yes sure bye"}


def docs(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choices(["code", "news", "chat"], [6, 3, 1])[0]
        text = " ".join(rng.choice(VOCAB[s].split()) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, rng.choice([s, s.upper(), f" {s}", s]) if rng.random() > 0.1 else None))
    return rows


def test_shares_are_met(spark):
    df = spark.createDataFrame(docs(3000), DOCS)
    targets = spark.createDataFrame([("m", "Code", 2.0, 2, 0.5), ("m", "news", 1.0, None, 0.5), ("m", "chat", 1.0, 4, 0.5), ("n", "chat", 1.0, 1, 1.0), ("n", "gone", 1.0, None, 1.0)], TARGETS)
    documents, shares = mix(df, targets)
    got = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    for s, share in (("code", 0.5), ("news", 0.25), ("chat", 0.25)):
        assert abs(got["m", s]["actual_share"] - share) < 0.01, (s, got["m", s])
        assert abs(got["m", s]["actual_tokens"] - got["m", s]["target_tokens"]) < 0.03 * got["m", s]["target_tokens"]
    assert got["n", "gone"]["actual_tokens"] == 0 and got["n", "chat"]["actual_tokens"] <= got["n", "chat"]["available_tokens"] * 1.05 + 1
    most = {r["mix_name"] + r["source"]: r["m"] for r in documents.groupBy("mix_name", "source").agg(F.max("repeats").alias("m")).collect()}
    assert most["mcode"] <= 2 and most["mchat"] <= 4 and most["nchat"] == 1
    assert documents.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0


def test_unlabelled_documents_go_where_they_belong(spark):
    rows = docs(2000)
    truth = {i: next(s for s, v in VOCAB.items() if t.split()[0] in v.split()) for i, t, _ in rows}
    targets = spark.createDataFrame([("m", s, 1.0, None, 1.0) for s in VOCAB], TARGETS)
    documents, _ = mix(spark.createDataFrame(rows, DOCS), targets)
    unknown = {i for i, _, s in rows if s is None}
    got = [(r["source"], truth[r["doc_id"]]) for r in documents.collect() if r["doc_id"] in unknown]
    assert len(got) > 50 and sum(a == b for a, b in got) / len(got) > 0.95


def test_gradient_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 3, 40)
    tokens = rng.integers(10, 100, 40).astype(float)
    units = spark.createDataFrame([(i, float(tokens[i]), p[i].tolist(), [5.0]) for i in range(40)], "unit int, tokens double, p array<double>, limits array<double>")
    target = np.array([[800.0, 500.0, 300.0]])
    fitted, expected = fit_rates(units, ["m"], target, ["a", "b", "c"])
    out = fitted.orderBy("unit").collect()
    rates = np.array([r["rates"][0] for r in out])
    assert rates.min() >= 0 and rates.max() <= 5
    assert np.abs((rates * tokens) @ p - target[0]).max() < 2.0
    assert np.abs((rates * tokens) @ p - expected[0]).max() < 1e-6 * target.sum()


def test_tokens_and_keys(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("é" * 50_000,)], "text string")
    counts = [r["tokens"] for r in with_tokens(df, "text").collect()]
    assert counts[:3] == [2, 0, 0] and counts[3] > 1000
    keys = spark.createDataFrame([(" A-b ",), ("a_B",), ("a b",), (" ",), (None,)], "s string").select(source_key(F.col("s")).alias("k"))
    assert [r["k"] for r in keys.collect()] == ["a_b", "a_b", "a_b", None, None]


def test_edge_cases(spark):
    targets = spark.createDataFrame([("m", "a", 1.0, None, 1.0), ("m", None, 1.0, None, 1.0), (None, "a", 1.0, None, 1.0)], TARGETS)
    documents, shares = mix(spark.createDataFrame([], DOCS), targets)
    assert documents.count() == 0 and shares.count() == 1
    some = spark.createDataFrame([(1, "x y", "a", 1, "p"), (2, None, "a", 1, "p"), (3, "", None, 1, "p"), (1, "x y", "a", 1, "p")], DOCS + ", tokens int, repeats string")
    documents, _ = mix(some, targets)
    assert {r["doc_id"] for r in documents.collect()} == {1}
    none, shares = mix(some, spark.createDataFrame([], TARGETS))
    assert none.count() == 0 and shares.count() == 0


def test_any_number_of_sources(spark):
    """Sources without target need no column, and are not used."""
    rows = [(i, "x y z", f"s{i}") for i in range(1200)] + [(5000 + i, "x y z w", "s1") for i in range(50)]
    documents, shares = mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("m", "s1", 1.0, None, 0.01), ("m", "s2", 1.0, None, 0.01)], TARGETS))
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == {"s1", "s2"} and abs(got["s1"]["actual_share"] - 0.5) < 0.2
    assert {r["source"] for r in documents.collect()} == {"s1", "s2"}


def test_line_beginnings_of_the_whole_text_count():
    text = "\n".join(["plain line"] * 60 + ["## heading"])
    assert "l:## headi" in mixing.text_features(text)
