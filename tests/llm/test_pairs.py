import random

import pytest

from assaykit.llm import pairs as P

NOUNS = ["report", "ticket", "query", "invoice", "summary", "trace", "answer", "sample"]
TAILS = ["during the second run", "over the weekend", "after the cache was cleared", "because the source had moved", "as the reviewer had asked"]
FR = ["La note de {n} a reçu {k} points, puis le modèle l'a retenue.", "Sur {k} notes, il en restait deux après la mise à jour.", "Le planificateur a rejeté la note parce que la source avait changé."]


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        name = "".join(rng.choice(["Bel", "Kor", "Min", "Tar", "vo", "na", "ri"]) for _ in range(2)).capitalize()
        a, b, k = rng.choice(NOUNS), rng.choice(NOUNS), rng.randint(2, 90)
        kind = rng.randrange(7)
        if kind == 0:
            out.append((f"How many {a}s did {name} keep?", f"It kept {k} of the {a}s {rng.choice(TAILS)}."))
        elif kind == 1:
            out.append((f"What is the {a} of {name}?", f"The {a} of {name} is the {b}, and it was checked {rng.choice(TAILS)}."))
        elif kind == 2:
            out.append((f"Que veut dire la note de {name} ?", " ".join(rng.sample(FR, 2)).format(n=name, k=k)))
        elif kind == 3:
            out.append((f"Please reply in French about the {a}.", rng.choice(FR).format(n=name, k=k)))
        elif kind == 4:
            out.append((f"Repeat this sentence word for word: The {a} of {name} is {b}.", f"The {a} of {name} is {b}."))
        elif kind == 5:
            out.append((f"Update the guide for {name}", f"The guide for {name} now explains how the {a} is handled {rng.choice(TAILS)}"))
        else:
            out.append((f"Tell the user about the delay at {name}", f"I'm sorry for the delay at {name}; the {a} arrives in {k} days."))
    return out


@pytest.fixture(scope="module")
def fitted():
    return P.fit(corpus(2500))


def judge(fitted, *pairs):
    vocabulary, model = fitted
    return model.decide([P.indices(P.features(q, a, vocabulary)) for q, a in pairs])


def test_held_out_accuracy(fitted):
    sound = corpus(600, seed=77)
    made = P.synthesize(sound, 123)
    got = judge(fitted, *[(q, a) for _, q, a, _ in made])
    want = [None if k is None else P.DEFECTS[k] for _, _, _, k in made]
    for k, name in enumerate(P.DEFECTS):
        at = [i for i, w in enumerate(want) if w == name]
        recall = sum(got[i] == name for i in at) / len(at)
        assert recall >= (0.85 if name == "truncated" else 0.95), (name, recall)
    wrong = sum(g is not None for g in judge(fitted, *sound)) / len(sound)
    assert wrong <= 0.02


def test_plain_cases(fitted):
    q = "How many tickets did Korri keep?"
    assert judge(fitted, (q, ""), (q, " ​\n"), (q, "<p></p>"), (q, "N/A"), (None, "..."), (q, "{}"), (q, "&nbsp;"), (q, "no answer given")) == ["empty"] * 8
    assert judge(fitted, (q, q.upper()), (q, f'"{q}"'), (q, f"{q} {q}")) == ["copy"] * 3
    assert judge(fitted, (q, q + " It kept 5 of the tickets over the weekend.")) == [None]
    assert judge(fitted, (q, "I'm sorry, but I can't help with that."), (q, "As an AI model I am not able to discuss this topic.")) == ["refusal"] * 2
    assert judge(fitted, (q, "Le planificateur a rejeté la note parce que la source avait changé.")) == ["language"]
    assert judge(fitted, (None, "Le planificateur a rejeté la note parce que la source avait changé.")) == [None]
    assert judge(fitted, (q, "It kept 5 of the tickets because the"), (q, "It kept 5 of the tickets over the weekend. (for example, the")) == ["truncated"] * 2


def test_languages():
    assert P.language("The cat is on the table and it was there before.") == "en"
    assert P.language("Die Spur wurde nach dem Lauf verworfen, weil die Quelle fehlt.") == "de"
    assert P.language("¿Por qué la factura es larga?") == "es" and P.language("Pourquoi la note est-elle longue ?") == "fr"
    assert P.language("这是一个回答。") == "zh" and P.language("チームが古い回答を読み直した") == "ja" and P.language("Команда прочитала ответы") == "ru"
    assert P.language("42") == "" and P.language("Quinlorjor") == ""


SCHEMA = "table_name string, record_id long, q string, a string"


def test_edge_cases(spark):
    assert P.find_defects(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("t", i, q, a) for i, (q, a) in enumerate(corpus(800, 5))]
    extra = [("t", 9001, None, None), ("t", 9001, None, None), ("u", None, "q", " "), ("t", 9002, "How many tickets did Korri keep?", "It kept 5 of the tickets over the weekend. " * 20_000)]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    got = [tuple(r) for r in P.find_defects(df).where("record_id > 9000 or record_id is null").collect()]
    assert sorted(got, key=str) == sorted([("t", 9001, "empty"), ("t", 9001, "empty"), ("u", None, "empty")], key=str)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "q", "", "x", "y")], "id long, input string, expected string, q string, defect string")
    pairs = P.pairs_of(df, "t", "id", "input", "expected")
    assert [tuple(r) for r in P.find_defects(pairs).collect()] == [("t", 1, "empty")]


def test_fit_is_the_same_each_time():
    a, b = P.fit(corpus(300)), P.fit(list(reversed(corpus(300))))
    assert (a[1].w == b[1].w).all() and (a[1].thresholds == b[1].thresholds).all()


def test_what_follows_the_first_tokens_counts(fitted):
    q = "How many tickets did Korri keep?"
    preamble = "Thank you for your question about the quarterly report of the northern office, which I read with care."
    assert judge(fitted, (q, f"{preamble} I am not able to help with that."), (q, f"{preamble} Unfortunately, I must decline to answer this question. Thank you for understanding.")) == ["refusal"] * 2
    assert judge(fitted, (q, f"{preamble} It kept 5 of the tickets over the weekend."), (q, f"{preamble} I'm sorry for the delay. It kept 5 of the tickets over the weekend.")) == [None] * 2


def test_every_token_has_features(fitted):
    words = [f"{w} {x}" for w in NOUNS for x in ("the", "of", "in", "was", "kept")]
    text = "It kept 5 of the tickets over the weekend because " + " ".join(words) + ". Then " + " and ".join(words) + ". It was kept."
    vocabulary = fitted[0]
    tokens = [vocabulary.token(t) for t in P._TOKEN.findall(text)]
    marks = {x.split(":", 1)[1] for x in P.features("q", text, vocabulary) if x.split(":", 1)[0].strip("\0") in ("u", "mu", "lu")}
    assert marks == set(tokens)


def test_short_answers_are_no_empty_ones():
    q = "How many tickets did Korri keep?"
    rng = random.Random(9)
    brief = [(f"How many {rng.choice(NOUNS)}s did run {i} keep?", rng.choice((str(rng.randint(0, 500)), "None of them.", "Yes", "No", "Tarvo", "A"))) for i in range(150)]
    fitted = P.fit(corpus(1500) + brief)
    assert judge(fitted, (q, "62"), (q, "Yes"), (q, "Mirquinkas"), (q, "B")) == [None] * 4
    assert judge(fitted, (q, "[none]"), (q, "<p>No answer</p>"), (q, "null"), (q, "TBD")) == ["empty"] * 4


def test_all_labels_are_given(spark):
    rows = [("t", i, q, a) for i, (q, a) in enumerate(corpus(800, 5))] + [("t", 9001, "How many tickets did Korri keep?", "")]
    got = {r["record_id"]: r["labels"] for r in P.label_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 801 and [x["defect"] for x in got[9001]][0] == "empty"
    assert all(x["margin"] > 0 and y["margin"] <= x["margin"] for v in got.values() for x, y in zip(v, v[1:], strict=False))


def test_repeated_pairs_do_not_thin_the_sample(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("t", i, q, a) for i, (q, a) in enumerate(corpus(200, 4))], SCHEMA)
    distinct = rows.select("q", "a").distinct().count()
    assert len(P._sample(rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(1000)))))) == distinct


def test_only_long_responses(spark):
    """Responses beyond the sample's bound are judged, and their first sentences fitted on."""
    rows = [("t", i, q, (a.rstrip(".") + ". ") * 700) for i, (q, a) in enumerate(corpus(40, 3))]
    got = P.find_defects(spark.createDataFrame([*rows, ("t", 99, "Why?", "")], SCHEMA)).collect()
    assert [r["defect"] for r in got if r["record_id"] == 99] == ["empty"]
    assert not any(r["defect"] == "empty" for r in got if r["record_id"] != 99)
