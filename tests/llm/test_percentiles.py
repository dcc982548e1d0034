import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest

from assaykit.llm.percentiles import bounds, duration_percentiles, merge, order_key, select, summarize

QS = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)


def rank_value(xs, q):
    xs = sorted(xs)
    return xs[max(1, math.ceil(round(q * len(xs), 6))) - 1]


def test_keys_keep_the_order():
    xs = [-math.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 1.0, 1.0000001, 7e22, math.inf]
    keys = order_key.func(pd.Series(xs)).tolist()
    assert keys == sorted(keys) and keys[4] == keys[5]
    assert order_key.func(pd.Series([float("nan"), None])).isna().all()


@pytest.mark.parametrize("kind", ["mixed", "ties", "integers"])
def test_exact_selection(spark, kind):
    rng = random.Random(3)
    draw = {"mixed": lambda: rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9), "ties": lambda: float(rng.randint(0, 3)), "integers": lambda: float(rng.randint(-5000, 5000))}[kind]
    rows = [(rng.choice(["a", "b", None]), draw()) for _ in range(4000)] + [("one", 5.0), ("a", None), ("a", float("nan")), ("gone", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r["g"], r["q"]): (r["n"], r["value"]) for r in select(df, ["g"], "v", QS).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    assert got == {(g, q): (len(xs), rank_value(xs, q)) for g, xs in groups.items() for q in QS}


def test_summaries_of_parts_combine_within_the_bound(spark):
    rng = np.random.default_rng(1)
    xs = np.exp(rng.normal(3, 4, 5000)) * rng.choice([-1, 1], 5000)
    df = spark.createDataFrame(pd.DataFrame({"day": rng.integers(0, 7, 5000), "v": xs}))
    whole = bounds(summarize(df, [], "v"), [], QS).orderBy("q").collect()
    parts = merge(summarize(df, ["day"], "v"), [])
    assert bounds(parts, [], QS).orderBy("q").collect() == whole
    for r in whole:
        exact = rank_value(xs.tolist(), r["q"])
        assert r["low"] <= exact <= r["high"] and r["high"] - r["low"] <= abs(exact) * 2**-11


def test_edge_cases(spark):
    schema = "project string, environment string, ingested_at timestamp, duration_ms long, day string, v string, key string"
    assert duration_percentiles(spark.createDataFrame([], schema)).count() == 0
    rows = [("A b", "Test", datetime.datetime(2025, 1, 1), 5, "x", "x", "x"), ("a-B ", "test", None, 7, "x", "x", "x"), (None, None, None, None, "x", "x", "x"), (None, "t", None, 2**60, "x", "x", "x")]
    got = duration_percentiles(spark.createDataFrame(rows, schema), [0.5]).where("value is not null").collect()
    assert {(r["project"], r["environment"], r["n"], r["value"]) for r in got} == {("a-b", "test", 2, 5.0), (None, "t", 1, float(2**60))}
