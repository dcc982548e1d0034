import random

import pytest

from assaykit.llm.leakage import Questions, _least_shared, find_leaks, leaks_in, question_bodies
from assaykit.llm.textnorm import squeezed

WORDS = ["harbour", "lens", "After", "the", "crooked", "drift", "moved", "from", "of", "a", "kiln", "needs", "packets", "per", "weeks", "Über", "straße", "12", "3071", "x-9"]


def question(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n))


def held(text, q):
    return bool(leaks_in([text], Questions([q])))


@pytest.fixture(scope="module")
def long_question():
    return question(random.Random(5), 40)


def test_length_and_budget(long_question):
    w = long_question.split()
    assert held("before " + " ".join(w[3:18]) + " after", long_question)
    assert not held("before " + " ".join(w[3:17]) + " after", long_question)
    one = w[3:18]
    one[7] = "zzz"
    assert held("before " + " ".join(one) + " after", long_question)
    two = [*one]
    two[3] = "yyyyy"
    assert not held("before " + " ".join(two) + " after", long_question)
    twenty = w[2:22]
    twenty[6], twenty[13] = "qqq", "ppppp"
    assert held("before " + " ".join(twenty) + " after", long_question)


@pytest.mark.parametrize(
    "change",
    [
        str.upper, lambda s: s.replace(" ", "\n> "), lambda s: s.replace(" ", "  ,  "), lambda s: "<b>" + s.replace(" the ", "</b> <i>the</i> <b>") + "</b>", lambda s: s.replace("harbour", "har-\nbour"),
        lambda s: s.replace("ü", "&uuml;").replace("Ü", "&Uuml;").replace("ß", "&szlig;"), lambda s: s.encode().decode("latin-1"), lambda s: s.replace(" ", "\xa0"), lambda s: s.replace("the", "t​he"),
        lambda s: s.replace("straße", "strasse"), lambda s: s.replace("e", "\\u0065"), lambda s: s.replace(" ", "%20"),
    ],
)
def test_forms_that_do_not_matter(long_question, change):
    assert held("before " + change(long_question) + " after", long_question)


def test_against_a_word_by_word_search():
    """Planted stretches with substitutions, found or not as the definition says."""
    rng = random.Random(11)
    questions = [question(rng, rng.randint(15, 60)) for _ in range(30)]
    index = Questions(questions)
    texts, expected = [], set()
    for i in range(400):
        k = rng.randrange(30)
        w = [squeezed(x)[0] for x in questions[k].split()]
        size = rng.randint(8, len(w))
        at = rng.randint(0, len(w) - size)
        part = w[at : at + size]
        changed = set()
        for j in range(size):
            if rng.random() < 0.12:
                part[j] = "".join(rng.choice("qjxz") for _ in range(rng.randint(2, 7)))
                changed.add(j)
        texts.append("qzj " * 5 + " ".join(part) + " jzq" * 5)
        ok = [j not in changed for j in range(size)]
        if any(ok[a] and ok[b - 1] and b - a >= 15 and 10 * (b - a - sum(ok[a:b])) <= b - a for a in range(size) for b in range(a + 15, size + 1)):
            expected.add((i, k))
    got = set(leaks_in(texts, index))
    assert expected <= got
    assert got == expected


def test_bound_never_drops_a_region():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(15, 50))]
        least = _least_shared(sizes)
        n = 15
        at = rng.randint(0, len(sizes) - n)
        part = sizes[at : at + n]
        assert least <= max(1, sum(part) - 11 - (max(part) + 11))


ITEMS = "item_id long, question string"
DOCS = "doc_id long, text string"


def test_instruction_lines_and_repeated_questions(spark, long_question):
    rng = random.Random(8)
    lead = "Read the case below with great care and then choose the single best answer from these four options."
    other = question(rng, 30)
    items = spark.createDataFrame([(1, f"{lead}\n{long_question}"), (2, f"{lead}\n{other}"), (3, long_question), (4, "too short"), (5, None), (6, "")], ITEMS)
    assert dict(question_bodies(items).where("item in (1, 3)").collect()) == {1: long_question, 3: long_question}
    docs = spark.createDataFrame([(10, lead), (11, f"x {long_question} y"), (12, other), (13, None), (14, ""), (11, f"x {long_question} y"), (15, "é" * 300_000 + " " + other)], DOCS)
    got = sorted(tuple(r) for r in find_leaks(docs, items).collect())
    assert got == [(11, 1), (11, 1), (11, 3), (11, 3), (12, 2), (15, 2)]


def test_edge_cases(spark, long_question):
    items = spark.createDataFrame([(1, long_question)], ITEMS)
    assert find_leaks(spark.createDataFrame([], DOCS), items).count() == 0
    docs = spark.createDataFrame([(1, long_question, 5, "x", "y")], DOCS + ", item long, body string, lines string")
    assert find_leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert find_leaks(docs, items.selectExpr("*", "1 as pos", "'x' as line", "'y' as shared")).count() == 1


def test_blocks_of_questions(spark, long_question, monkeypatch):
    import assaykit.llm.leakage as leakage

    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    rng = random.Random(4)
    qs = [question(rng, 25) for _ in range(12)]
    items = spark.createDataFrame(list(enumerate(qs)), ITEMS)
    docs = spark.createDataFrame([(100 + i, "a " + q + " b") for i, q in enumerate(qs)], DOCS)
    assert sorted(tuple(r) for r in find_leaks(docs, items).collect()) == [(100 + i, i) for i in range(12)]


def test_words_of_any_length_may_differ(long_question):
    w = long_question.split()
    for size in (1, 30, 60, 400):
        other = "".join(random.Random(size).choice("abcdefgh") for _ in range(size))
        replaced, added = w[3:18], w[3:18]
        replaced[7] = other
        added.insert(7, other)
        missing = w[3:20]
        del missing[8]
        for part in (replaced, added, missing):
            assert held("before it " + " ".join(part) + " after", long_question)
    long = [*w[:20], "y" * 90, *w[20:]]  # the question's own word is long, and missing or short in the text
    assert held("so " + " ".join([*w[12:20], *w[20:30]]), " ".join(long))
    assert held("so " + " ".join([*w[12:20], "z", *w[20:30]]), " ".join(long))


def test_words_put_in_count(long_question):
    w = long_question.split()
    assert not held(" ".join([*w[3:10], *(f"other{i}" for i in range(9)), *w[10:18]]), long_question)


def test_short_words():
    letters = list("abcdefghijklmnop")
    q = " ".join(letters)
    assert held("so " + q + " it", q)
    changed = [*letters]
    changed[8] = "z"
    assert held("so " + " ".join(changed) + " it", q)
    changed[4] = "y"
    assert not held("so " + " ".join(changed) + " it", q)
    assert not held("so " + " ".join(letters[:14]) + " it", q)


def test_short_and_long_words_against_a_word_by_word_search():
    """Words of one to thirty letters, one or two of a stretch differing in any length."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    sizes = (1, 1, 1, 2, 2, 3, 5, 8, 30)
    questions = [" ".join(word(rng.choice(sizes)) for _ in range(rng.randint(15, 45))) for _ in range(12)]
    index, texts, expected = Questions(questions), [], set()
    for i in range(300):
        k = rng.randrange(12)
        w = questions[k].split()
        size = rng.randint(13, len(w))
        at = rng.randint(0, len(w) - size)
        part, ok = w[at : at + size], [True] * size
        for j in rng.sample(range(size), rng.choice((0, 1, 1, 2, 3))):
            part[j], ok[j] = "qzx" * rng.choice((1, 2, 20)), False
        texts.append("0 " + " ".join(part) + " 0")
        if any(ok[a] and ok[b - 1] and b - a >= 15 and 10 * (b - a - sum(ok[a:b])) <= b - a for a in range(size) for b in range(a + 15, size + 1)):
            expected.add((i, k))
    assert set(leaks_in(texts, index)) == expected


def test_corpus_is_read_once(spark, long_question, monkeypatch, tmp_path):
    import assaykit.llm.leakage as leakage

    spark.createDataFrame([(1, long_question)], DOCS).write.parquet(str(tmp_path / "docs"))
    for size in (10_000, 40):
        monkeypatch.setattr(leakage, "BLOCK_CHARS", size)
        items = spark.createDataFrame([(i, long_question + f" {i}") for i in range(9)], ITEMS)
        found = find_leaks(spark.read.parquet(str(tmp_path / "docs")), items)
        assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
        assert found.count() == 9
