import random

import pytest

from assaykit.llm import residue
from assaykit.llm.residue import HAMMING, SHINGLE, blocks_for, core, find_residue, similar, simhashes, spread, trusted

DOCS = "doc_id long, text string"


@pytest.mark.parametrize(
    "text",
    [
        "dear {{name}}, thank you", "hello {% if user %}", "we compared ${metric} with $team$.", "contact <company> if", "best regards, ##topic##", "@@date@@ was", "for __date__ now", "of [[date]]: x", "hello &lt;%= user %&gt;",
        "%(user_name)s looks wrong", "[your name]", "(company name goes here)", "(insertar nombre aquí)", "[nom du produit à compléter]", "xxxx to be filled in xxxx", "todo: write this section", "title goes here", "your text here",
        "lorem ipsum dolor sit amet magna", "blah blah blah blah blah blah blah", "undefined undefined [object object] nan", "sample paragraph, replace later.", "dies ist ein blindtext.", "texte provisoire.",
        "000 not found", "000 - page not found.", "http 000: this resource was removed.", "<html><head><title>000 bad gateway</title></head></html>", '{"status": "error", "detail": "gone", "code": 000}', "your session has expired.",
        "access denied.", "something broke on our side, please try again in a few minutes.", "<html><head><title>error 0000</title></head></html>", "seite nicht gefunden.", "erreur interne du serveur.", "página no encontrada.", "javascript is disabled in your browser; turn it on and reload.", "this site requires scripts.",
        "veuillez activer javascript pour afficher cette page.", "checking your browser before you continue.", "the viewer works only with scripting allowed.",
    ],
)
def test_residue_rules(text):
    assert trusted(text) > 0


@pytest.mark.parametrize(
    "text",
    [
        "the template fills `{{ question }}` before each call.", "designers of x used lorem ipsum in the first mock-up.", "the todo list of x has 0 open points.", "the set {a, b, c} has 0 subsets, and $x_{i}$ is one.",
        "in python the line `print(f\"{x}\")` prints it.", "a 000 internal server error in span 0 was caught by the loader.", "of 0 pages that it fetched, 0 answered with 000 not found and were retried.",
        "the crawl report lists pages that only show a request to enable javascript.", "when the session has expired, the planner signs in again.", "the shell step sets `${run_dir}` and calls it.", "the error rate doubled.",
        "000 ms was the median.", "<p>a paragraph</p>", "the page was good and the script ran.", "costs $0 and $00 a month", "see [0] and (appendix a)", "",
    ],
)
def test_sound_rules(text):
    assert trusted(text) <= 0


def test_tables_find_every_pair_within_the_distance(spark):
    """Whatever the number of blocks, two SimHashes within HAMMING bits share a table key."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    for m in (4, 5, 6, 7):
        rows = []
        for i in range(60):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(0, HAMMING)):
                b ^= 1 << bit
            rows.append((i, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
        df = spark.createDataFrame(rows, "i int, a long, b long")
        met = df.where(F.arrays_overlap(residue.table_keys(F.col("a"), m), residue.table_keys(F.col("b"), m)))
        assert met.count() == 60
    assert [blocks_for(n) for n in (10, 1 << 21, 1 << 28)] == [4, 5, 5] or blocks_for(10) == 4


def judged(spark, rows):
    """What judge_passages gives, with labels of the test's own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "passage string, label byte")
    return df.select(F.xxhash64("passage").alias("id"), "passage", "label", residue._judged("passage", F.lit(False)).alias("j")).select("id", "passage", "label", "j.node", "j.sim")


def reached(spark, rows):
    from pyspark.sql import functions as F

    got = judged(spark, rows).join(spread(judged(spark, rows)), "id", "left_semi")
    return {r["passage"] for r in got.select(F.col("passage")).collect()}


def shingles(text):
    words = core(text).split()
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def distance(a, b):
    x, y = simhashes([core(a), core(b)]).tolist()
    return bin((x ^ y) & (2**64 - 1)).count("1")


def test_simhash_of_like_texts_is_near():
    words = [f"w{i}" for i in range(60)]
    assert distance(" ".join(words), " ".join([*words[:59], "other"])) < distance(" ".join(words), " ".join(f"v{i}" for i in range(60)))


def test_simhashes_do_not_depend_on_the_batch():
    texts = [core(x) for x in ("one", "two words", "a b c d", "a b c d e", "a b c d e f g h", "é ü 0 x y z")]
    assert simhashes(texts).tolist() == [simhashes([t]).tolist()[0] for t in texts]


def test_similarity_is_that_of_shingles():
    rng = random.Random(3)
    for _ in range(60):
        a = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 50))]
        b = a[:]
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = "x"
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert similar(core(" ".join(a)), core(" ".join(b))) == (len(x & y) >= 0.8 * len(x | y))


def test_labels_spread_along_links_only(spark):
    base = [f"word{i}" for i in range(40)]
    far = [f"far{i}" for i in range(20)] + base[20:]
    sound = "sound " + " ".join(base)
    rows = [(" ".join(base), 1), ("oh no: " + " ".join(base), 0), (" ".join(base) + "!", 0), (" ".join(far), 0), ("short one", 0), ("short one too", 1), ("hm, short one too", 0), ("this resource was removed", 1), ("sorry, this resource was removed.", 0)]
    got = reached(spark, [*rows, (sound, -1)])
    assert got == {" ".join(base), "oh no: " + " ".join(base), " ".join(base) + "!", "short one too", "this resource was removed", "sorry, this resource was removed."}


def test_propagation_equals_brute_force(spark):
    """All links of a random set of near-copies, within the Hamming distance and of the similarity, against comparing all pairs."""
    rng = random.Random(6)
    texts = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(8):
            t = base[:]
            for _ in range(rng.randint(0, 2)):
                t[rng.choice([0, 1, 148, 149])] = f"z{rng.randint(0, 99)}"
            texts.append(" ".join(t))
    texts = sorted(set(texts))
    labels = {t: int(rng.random() < 0.2) for t in texts}
    near = lambda a, b: distance(a, b) <= HAMMING and similar(core(a), core(b))
    expected = {t for t in texts if labels[t]}
    seeds = len(expected)
    while new := {t for t in texts if t not in expected and any(near(t, r) for r in expected)}:
        expected |= new
    assert len(expected) > seeds
    assert reached(spark, list(labels.items())) == expected


def test_chain_of_many_hops(spark):
    """Each text differs from the next in one word; the label goes to the end of the chain."""
    words = [f"w{i}" for i in range(900)]
    chain = [" ".join(words)]
    for i in range(14):
        words[(i * 61 + 3) % 900] = f"new{i}"
        chain.append(" ".join(words))
    linked = 1
    while linked < len(chain) and distance(chain[linked - 1], chain[linked]) <= HAMMING:
        linked += 1
    got = reached(spark, [(t, int(i == 0)) for i, t in enumerate(chain)])
    assert linked > 3 and set(chain[:linked]) <= got


def test_error_messages_come_by_spreading(spark):
    """The message is known from pages with a status; without one it is found through its component."""
    rows = [(1, "404 Not Found | Your request was blocked."), (2, "Whoops, your request was blocked."), (3, "The log says that your request was blocked by a rule."), (4, "Sound text.\nHm, your request was blocked!\nMore.")]
    assert trusted("whoops, your request was blocked.") == 0
    assert sorted(r["doc_id"] for r in find_residue(spark.createDataFrame(rows, DOCS)).collect()) == [1, 2, 4]


@pytest.mark.parametrize("text", ["Dear [CUSTOMER], thanks.", "Hi <customer name>, welcome", "Ask [FIRST NAME] for it.", "Traceback (most recent call last): File \"a.py\", line 3", "Pagina non trovata", "Site en maintenance, revenez plus tard."])
def test_slots_and_errors_by_form(spark, text):
    assert find_residue(spark.createDataFrame([(1, text)], DOCS)).count() == 1


@pytest.mark.parametrize("text", ["[INFO] all is well", "An <em>odd</em> <br clear> mark", "See [Smith] and [1].", "A traceback (most recent call last) was logged.", "Access denied rates rose by 5 in May."])
def test_sound_forms(spark, text):
    assert find_residue(spark.createDataFrame([(1, text)], DOCS)).count() == 0


def test_no_rule_holds_without_a_sign(spark):
    """What the rules label shows a sign, else it would not be asked for."""
    from pyspark.sql import functions as F

    texts = [p for mark in (test_residue_rules, test_wording_beside_residue_does_not_save_it) for p in mark.pytestmark[0].args[1]]
    df = spark.createDataFrame([(t,) for t in texts], "passage string").where(~F.col("passage").rlike(residue._signs()))
    assert [r[0] for r in df.collect()] == []


def test_documents(spark):
    sound = "The TODO list of Xa has 3 open points.\nAll is well."
    rows = [(1, sound), (2, sound + "\n\n404 Not Found"), (3, None), (4, ""), (5, "Item\nItem\nHeading"), (6, "ALL IS {COMPANY} AND " + "word " * 300_000), (7, "```\nx = '{{name}}'\n```\nfine"), (2, sound + "\n\n404 Not Found")]
    assert sorted(r["doc_id"] for r in find_residue(spark.createDataFrame(rows, DOCS)).collect()) == [2, 5, 6]
    assert find_residue(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "404 Not Found", "x", 3)], DOCS + ", passage string, label int")
    assert find_residue(clash).count() == 1


@pytest.mark.parametrize(
    "text",
    [
        "the record of {{customer_name}} was opened on {{date}}.", "in python we greet {{name}} with `print(x)`.", "before each call, the agent asks for <company>.", "the style guide of [your company] applies.", "the shell step of ${project name} ran.",
        "designers of {{product}} met.", "the template fills `{{ question }}`, dear {{name}}.", "the company replaces {{product}} free of charge.", "todo: run `make` in python", "error 000: the record was not found", "please enable javascript to view the reports.",
        "javascript is disabled, so the listed items are hidden.", "this page requires javascript because the tool draws in your browser.", "tests are listed once you enable javascript.",
    ],
)
def test_wording_beside_residue_does_not_save_it(text):
    assert trusted(text) > 0


@pytest.mark.parametrize(
    "text",
    [
        "the template fills {{ question }} and {{ context }} before each call.", "the placeholder \"{{name}}\" is replaced later.", "write [your name] style slots in capitals.", "``{{ name }}`` is a slot.", "`config.yaml` not found.", "insert `{{ name }}` here.", "the placeholder [[your name]] is replaced later.",
        "pages that require javascript were dropped.", "the ticket says that javascript is disabled there.",
    ],
)
def test_residue_that_is_spoken_of_is_sound(text):
    assert trusted(text) <= 0


def test_documents_with_residue_beside_odd_wording(spark):
    rows = [(1, "The record of {{customer_name}} was opened on {{date}}."), (2, "Please enable JavaScript to view the reports."), (3, "In Python the line `print(f\"{x}\")` prints it.")]
    assert sorted(r["doc_id"] for r in find_residue(spark.createDataFrame(rows, DOCS)).collect()) == [1, 2]
