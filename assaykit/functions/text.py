"""Text expressions: normalisation, answers, token overlap, splitting into claims and chunks, heuristics.

Every function takes and returns Columns and stays inside the JVM. Null text gives a null result, or the
value the docstring names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the query heuristics.
QUESTION_WORDS = ("what", "how", "why", "when", "where", "who", "which")
SPECIFIC_WORDS = ("specific", "exact", "precise", "detailed", "particular")
VAGUE_WORDS = ("it", "this", "that", "these", "those", "thing", "stuff")
FORGETFUL_QUESTIONS = (r"\bwhat is your name\b", r"\bwho are you\b", r"\bwhere are you from\b", r"\bhow old are you\b", r"\bwhat do you do\b")

# Patterns of the answer ladder and of multi-pattern matching.
ANSWER_PATTERN = r"(?:Answer|answer):\s*([A-Za-z0-9]+)"
ANSWER_IS = r"(?:the\s+(?:correct\s+)?answer\s+is\s+)([A-D])"
BOLD_CHOICE = r"\*\*([A-D])\.\s*[^*]*\*\*"
MULTI_PATTERNS = (ANSWER_PATTERN, ANSWER_IS, BOLD_CHOICE, r"^([A-D])\.?\s*$", r"^([A-D])[\.\:]", r"\b([A-D])\b", r"([A-D])\s*$")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it; without it an expression is evaluated at every use."""
    return F.get(F.transform(F.array(c), f), 0)


def strip(c: Column) -> Column:
    """Without blanks at either end; unlike trim, line breaks and tabs are blanks too."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def words(c: Column) -> Column:
    """Blank-separated words; none of blank text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def token_set(c: Column) -> Column:
    """Distinct runs of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def exact_match(pred: Column, truth: Column, case_sensitive: bool = True, strip_whitespace: bool = True, normalize_whitespace: bool = False) -> Column:
    """1.0 or 0.0; a null on either side is 0.0. The steps are strip, collapse, lower, in this order."""

    def norm(c: Column) -> Column:
        c = strip(c) if strip_whitespace else c
        c = collapse(c) if normalize_whitespace else c
        return c if case_sensitive else F.lower(c)

    return F.coalesce((norm(pred) == norm(truth)).cast("double"), F.lit(0.0))


def extract_answer(text: Column, pattern: str = ANSWER_PATTERN) -> Column:
    """The answer a response gives: the first rule of the ladder that yields one.

    Named answer; "the answer is X"; bold choice; a letter alone; a letter that starts a line; a letter in
    one of the last three lines, from the end; a final letter; the last letter anywhere; the first word.
    """
    s = strip(text)
    letter = F.lit(r"(?i)\b([A-D])\b")
    lines = F.split(s, "\n")
    tail = F.reverse(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 2), F.lit(3)))
    in_tail = F.filter(F.transform(tail, lambda x: F.regexp_extract(x, r"(?i)\b([A-D])\b", 1)), lambda x: x != "")
    return F.coalesce(
        first_match(text, "(?i)" + pattern),
        first_match(text, "(?i)" + ANSWER_IS),
        first_match(text, "(?i)" + BOLD_CHOICE),
        first_match(s, r"(?i)^([A-D])\.?\s*$"),
        first_match(text, r"(?im)^([A-D])[\.\:]"),
        F.try_element_at(in_tail, F.lit(1)),
        first_match(s, r"(?i)([A-D])\s*$"),
        F.try_element_at(F.regexp_extract_all(text, letter, F.lit(1)), F.lit(-1)),
        F.try_element_at(F.split(s, r"\s+"), F.lit(1)),
    )


def choice_of(letter: Column, choices: Column) -> Column:
    """The choice that A..D stands for; null for other text and letters beyond the choices."""
    up = F.upper(strip(letter))
    return F.when(up.rlike("^[A-D]$"), F.get(choices, F.ascii(up) - 65))


def answer_accuracy(pred: Column, truth: Column, choices: Column | None = None, pattern: str = ANSWER_PATTERN) -> Column:
    """1.0 if the extracted answer, or the choice it stands for, is the truth; case and blanks aside."""
    norm = lambda c: F.lower(strip(c))
    answer = extract_answer(pred, pattern)
    given = answer if choices is None else F.coalesce(choice_of(answer, choices), answer)
    return F.coalesce((norm(given) == norm(truth)).cast("double"), F.lit(0.0))


def all_answers(text: Column, patterns: Sequence[str] = MULTI_PATTERNS, groups: Sequence[int] | None = None) -> Column:
    """Distinct answers that any pattern finds, in the order of patterns; group 1 unless `groups` says otherwise."""
    groups = groups or [1] * len(patterns)
    found = [F.regexp_extract_all(text, F.lit("(?im)" + p), F.lit(g)) for p, g in zip(patterns, groups, strict=True)]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), strip), lambda x: x != ""))


def multi_pattern_accuracy(pred: Column, truth: Column, choices: Column | None = None, patterns: Sequence[str] = MULTI_PATTERNS, case_sensitive: bool = False) -> Column:
    """1.0 if any answer found, or the choice it stands for, is the truth."""
    norm = (lambda c: strip(c)) if case_sensitive else (lambda c: F.lower(strip(c)))

    def hit(x: Column) -> Column:
        same = norm(x) == norm(truth)
        return same if choices is None else same | F.coalesce(norm(choice_of(x, choices)) == norm(truth), F.lit(False))

    return F.coalesce(F.exists(all_answers(pred, patterns), hit).cast("double"), F.lit(0.0))


def token_f1(pred: Column, truth: Column, tokenize: bool = True, case_sensitive: bool = False) -> Column:
    """STRUCT<precision, recall, f1> of distinct tokens; all zero where either side has none."""
    side = lambda c: token_set(c) if tokenize else F.array_distinct(words(c))
    a, b = (side(c if case_sensitive else F.lower(c)) for c in (F.coalesce(pred, F.lit("")), F.coalesce(truth, F.lit(""))))

    def of(x: Column) -> Column:
        share = lambda n: F.coalesce(x["common"] / F.nullif(n, F.lit(0)), F.lit(0.0))
        f1 = F.when(x["common"] > 0, 2 * x["common"] / (x["n"] + x["m"])).otherwise(0.0)
        return F.struct(share(x["n"]).alias("precision"), share(x["m"]).alias("recall"), f1.alias("f1"))

    sets = F.struct(a.alias("a"), b.alias("b"))
    counts = let(sets, lambda x: F.struct(F.size(F.array_intersect(x["a"], x["b"])).cast("double").alias("common"), F.size(x["a"]).alias("n"), F.size(x["b"]).alias("m")))
    return let(counts, of)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays taken as sets; 0.0 if both are empty."""

    def of(x: Column) -> Column:
        union = F.size(F.array_union(x["a"], x["b"]))
        return F.when(union > 0, F.size(F.array_intersect(x["a"], x["b"])) / union).otherwise(0.0).cast("double")

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(words(F.lower(a)), words(F.lower(b)))


def mean(xs: Column) -> Column:
    """Mean of an array of doubles, 0.0 if it is empty."""
    return let(xs, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).otherwise(0.0))


def chunk_overlap(query: Column, chunks: Column) -> Column:
    """Mean word Jaccard of a query with each chunk; blank chunks count as 0."""
    return let(words(F.lower(query)), lambda q: mean(F.transform(chunks, lambda c: jaccard(q, words(F.lower(c))))))


def pairs(xs: Column) -> Column:
    """All pairs of places i < j of one row's array, as structs."""

    def of(v: Column) -> Column:
        n = F.size(v)
        first = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(first, lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(F.get(v, i).alias("a"), F.get(v, j).alias("b")))))

    return let(xs, of)


def chunk_diversity(chunks: Column) -> Column:
    """Mean of the share of distinct chunks and the mean pairwise word distance; 0.0 for fewer than two chunks."""

    def of(v: Column) -> Column:
        distance = mean(F.transform(pairs(F.transform(v, lambda c: words(F.lower(c)))), lambda p: 1.0 - jaccard(p["a"], p["b"])))
        return F.when(F.size(v) > 1, (F.size(F.array_distinct(v)) / F.size(v) + distance) / 2).otherwise(0.0)

    return let(chunks, of)


def distinct_share(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.size(F.array_distinct(xs)) / F.size(xs)).otherwise(0.0)


# --- splitting -----------------------------------------------------------------------------------------


def context_chunks(context: Column, least: int = 50) -> Column:
    """Paragraphs, or sentences where there is one paragraph, of at least `least` characters; else the whole."""
    parts = F.split(context, "\n\n")
    parts = F.when(F.size(parts) > 1, parts).otherwise(F.split(context, r"[.!?]+"))
    kept = F.filter(F.transform(parts, strip), lambda x: F.length(x) >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(context))


def paragraphs(context: Column) -> Column:
    return F.filter(F.transform(F.split(context, "\n\n"), strip), lambda x: x != "")


def _listed(text: Column, mark: str) -> Column:
    lines = F.transform(F.split(strip(text), "\n"), strip)
    items = F.filter(lines, lambda x: x.rlike(r"^[\p{Nd}*-]"))
    return F.filter(F.transform(items, lambda x: strip(F.regexp_replace(x, mark, ""))), lambda x: x != "")


def numbered_claims(text: Column) -> Column:
    """Items of a numbered (1. to 10.) or bulleted list, without their marks."""
    return _listed(text, r"^(?:10|[1-9])\.|^[-*]")


def numbered_questions(text: Column) -> Column:
    """Items that end in a question mark; marks 1. to 5. and bullets are dropped."""
    return F.filter(_listed(text, r"^[1-5]\.|^[-*]"), lambda x: x.endswith("?"))


def sentence_claims(text: Column, longer_than: int = 10, most: int | None = None) -> Column:
    claims = F.filter(F.transform(F.split(text, r"\."), strip), lambda x: F.length(x) > longer_than)
    return claims if most is None else F.slice(claims, 1, most)


def numbered_items(text: Column, longer_than: int = 0) -> Column:
    """What follows `n.` or `n)` in each line; none if the text says "none"."""
    lines = F.transform(F.split(strip(text), "\n"), lambda x: F.regexp_extract(strip(x), r"^\d+[.)]\s*(.+)$", 1))
    items = F.filter(F.transform(lines, strip), lambda x: F.length(x) > longer_than)
    return F.when(F.lower(strip(text)) == "none", F.array().cast("array<string>")).otherwise(items)


def listed_violations(text: Column) -> Column:
    """Lines after the first, unless the text or the line starts with NO."""
    lines = F.split(strip(text), "\n")
    rest = F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), strip), lambda x: (x != "") & ~F.upper(x).startswith("NO"))
    return F.when(F.upper(strip(text)).startswith("NO"), F.array().cast("array<string>")).otherwise(rest)


def choices_in(prompt: Column) -> Column:
    """Texts of the choices A to D that a prompt lists, one to a line."""
    return F.transform(F.regexp_extract_all(prompt, F.lit(r"\n([A-D])\.\s*([^\n]+)"), F.lit(2)), strip)


def choice_index(expected: Column, choices: Column) -> Column:
    """Place (from 0) of the first choice equal to the expected text, else of the first that holds or is held by it."""
    want = F.lower(strip(expected))
    norm = F.transform(choices, lambda c: F.lower(strip(c)))
    near = F.transform(norm, lambda c: c.contains(want) | want.contains(c))
    return F.coalesce(F.nullif(F.array_position(norm, want), F.lit(0)), F.nullif(F.array_position(near, F.lit(True)), F.lit(0))).cast("int") - 1


# Generation settings for multiple-choice prompts.
CHOICE_SETTINGS = {"max_tokens": 10, "temperature": 0.0, "stop": ["\n", "Question:"]}


def few_shot_header(subject: Column) -> Column:
    """The line that stands before the examples of a subject."""
    return F.concat(F.lit("Here are some example questions from "), F.initcap(F.replace(subject, F.lit("_"), F.lit(" "))), F.lit(":"))


def multiple_choice_prompt(question: Column, choices: Column) -> Column:
    listed = F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c, F.lit("\n"))), "")
    return F.concat(F.lit("Question: "), question, F.lit("\n"), listed, F.lit("Answer:"))


def subset_of(sample_id: Column) -> Column:
    """An id without its last `_` part; "unknown" if it has none."""
    return F.when(sample_id.contains("_"), F.regexp_replace(sample_id, r"_[^_]*$", "")).otherwise("unknown")


# --- heuristics ----------------------------------------------------------------------------------------


def query_clarity(q: Column) -> Column:
    n = F.size(words(q))
    return F.when(n < 3, 0.3).when(n > 20, 0.8).otherwise(0.6)


def query_intent(q: Column) -> Column:
    asks = F.lower(q).rlike("|".join(QUESTION_WORDS))
    specific = F.size(F.filter(words(q), lambda w: F.length(w) > 4)) > 1
    return F.when(asks & specific, 0.9).when(asks | specific, 0.6).otherwise(0.3)


def query_tidiness(q: Column) -> Column:
    return F.when((F.array_join(words(q), " ") == q) & (F.length(strip(q)) > 0), 0.8).otherwise(0.5)


def query_specificity(q: Column) -> Column:
    bonus = lambda c, x: F.when(c, x).otherwise(0.0)
    named = F.exists(words(q), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}"))
    score = 0.5 + bonus(F.lower(q).rlike("|".join(SPECIFIC_WORDS)), 0.2) + bonus(q.rlike(r"\p{Nd}"), 0.15) + bonus(named, 0.15)
    return F.least(score, F.lit(1.0))


def query_complexity(q: Column) -> Column:
    w = words(q)
    n, unique = F.size(w), F.size(F.array_distinct(w))
    size = mean(F.transform(w, lambda x: F.length(x).cast("double")))
    variety = unique / F.nullif(n, F.lit(0))
    return F.when(n == 0, 0.0).when((variety > 0.8) & (size > 6), 0.9).when((variety > 0.6) & (size > 5), 0.7).otherwise(0.5)


def query_unambiguity(q: Column) -> Column:
    vague = F.size(F.filter(words(F.lower(q)), lambda w: w.isin(*VAGUE_WORDS)))
    return 1.0 - F.least(vague / 3.0, F.lit(1.0))


QUERY_WEIGHTS = {"clarity": 0.25, "intent": 0.25, "tidiness": 0.2, "specificity": 0.15, "complexity": 0.1, "unambiguity": 0.05}


def query_quality(q: Column, weights: dict[str, float] = QUERY_WEIGHTS) -> Column:
    parts = {"clarity": query_clarity, "intent": query_intent, "tidiness": query_tidiness, "specificity": query_specificity, "complexity": query_complexity, "unambiguity": query_unambiguity}
    total = F.lit(0.0)
    for name, f in parts.items():
        total = total + f(q) * weights.get(name, 0.0)
    return total


def retention_heuristic(pred: Column) -> Column:
    """0.3 if the response asks for basics it should know, else 0.7."""
    return F.when(F.lower(pred).rlike("|".join(FORGETFUL_QUESTIONS)), 0.3).otherwise(0.7)


def completeness_heuristic(pred: Column) -> Column:
    return F.when(F.length(strip(pred)) < 10, 0.2).when(F.lower(pred).rlike("sorry|can't"), 0.4).otherwise(0.7)


def banded_reasoning(name: str, score: Column, labels: Sequence[str] = ("excellent", "good", "fair", "poor", "very poor")) -> Column:
    """One line on a score: its name, its value with three decimals, and the label of its band."""
    return F.concat(F.lit(f"{name}: "), F.format_number(F.coalesce(score, F.lit(0.0)), 3), F.lit(" ("), band(F.coalesce(score, F.lit(0.0)), labels), F.lit(")"))


def combined_reasoning(parts: dict[str, Column]) -> Column:
    """The reasonings of several scores, a line each, in order."""
    return F.concat_ws("\n", *[banded_reasoning(n, c) for n, c in parts.items()])


def band(score: Column, labels: Sequence[str], edges: Sequence[float] = (0.9, 0.7, 0.5, 0.3)) -> Column:
    """The label of the first edge that a score reaches, else the last label."""
    out = F.when(score >= edges[0], labels[0])
    for e, label in zip(edges[1:], labels[1:], strict=False):
        out = out.when(score >= e, label)
    return out.otherwise(labels[len(edges)])


def truthy(c: Column) -> Column:
    """BOOLEAN of true/1/yes/on and false/0/no/off, in any case; null for other text."""
    x = F.lower(strip(c))
    return F.when(x.isin("true", "1", "yes", "on"), True).when(x.isin("false", "0", "no", "off"), False)


def estimated_tokens(text: Column, rule: str = "quarter") -> Column:
    """Token estimates: quarter (characters / 4), at_least_one, double_words, or pieces (words and marks, one tenth more)."""
    if rule == "quarter":
        return F.floor(F.length(text) / 4)
    if rule == "at_least_one":
        return F.greatest(F.lit(1), F.floor(F.length(text) / 4))
    if rule == "double_words":
        return (2 * F.size(words(text))).cast("long")
    if rule == "pieces":
        pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))
        extra = F.aggregate(pieces, F.lit(0), lambda s, p: s + F.when(F.length(p) > 6, F.floor((F.length(p) - 1) / 6).cast("int")).otherwise(0))
        return F.floor((F.size(pieces) + extra + 2) * 1.1)
    raise ValueError(f"unknown rule {rule!r}")
