"""Queries of the text scorers and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import responses, text
from assaykit.operators import generation, samples
from assaykit.plans.registry import Registry, r6, rounded, table

REGISTRY = Registry()

_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_SET = "list_distinct(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'))"


def w(x: str) -> str:
    return _WORDS.format(x)


def st(x: str) -> str:
    return _STRIP.format(x)


def jac(a: str, b: str) -> str:
    both, union = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    return f"(case when {union} > 0 then {both} / {union}::double else 0.0 end)"


_PAIRS = """with p as (select qa_id, expected as pred,
  case when qa_id % 3 = 0 then upper(expected) when qa_id % 3 = 1 then '  ' || replace(expected, ' ', '   ') || chr(10) else input end as truth
  from qa_dataset)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("expected")
    truth = F.when(F.col("qa_id") % 3 == 0, F.upper(e)).when(F.col("qa_id") % 3 == 1, F.concat(F.lit("  "), F.replace(e, F.lit(" "), F.lit("   ")), F.lit("\n"))).otherwise(F.col("input"))
    return table(spark, d, "qa_dataset").select("qa_id", e.alias("pred"), truth.alias("truth"))


@REGISTRY.add(f"""{_PAIRS} select qa_id, coalesce(({st('pred')} = {st('truth')})::double, 0.0) as plain,
  coalesce((lower({st('pred')}) = lower({st('truth')}))::double, 0.0) as any_case,
  coalesce((lower(regexp_replace({st('pred')}, '\\s+', ' ', 'g')) = lower(regexp_replace({st('truth')}, '\\s+', ' ', 'g')))::double, 0.0) as any_space from p""")
def t1_exact_match(spark: SparkSession, d: str) -> DataFrame:
    p, t = F.col("pred"), F.col("truth")
    return _pairs(spark, d).select(
        "qa_id", text.exact_match(p, t).alias("plain"), text.exact_match(p, t, case_sensitive=False).alias("any_case"),
        text.exact_match(p, t, case_sensitive=False, normalize_whitespace=True).alias("any_space"),
    )


_PREDICTIONS = """with p as (select item_id, choices, choices[answer + 1] as truth, chr((65 + answer)::int) as letter, case item_id % 8
  when 0 then 'Answer: ' || chr((65 + item_id % 4)::int) when 1 then 'I think the correct answer is ' || chr((65 + answer)::int) || ', for sure.'
  when 2 then '**' || chr((65 + answer)::int) || '. ' || choices[answer + 1] || '**' when 3 then chr((65 + answer)::int) || '.'
  when 4 then 'Two remain' || chr(10) || chr((65 + answer)::int) || ': this one' when 5 then 'see below' || chr(10) || 'so (' || chr((65 + answer)::int) || ') it is' || chr(10) || 'end'
  when 6 then choices[answer + 1] else 'nothing' end as pred from eval_items)"""


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    i, letter, choice = F.col("item_id"), F.char(F.col("answer") + 65), F.get("choices", "answer")
    cases = [
        F.concat(F.lit("Answer: "), F.char(i % 4 + 65)), F.concat(F.lit("I think the correct answer is "), letter, F.lit(", for sure.")),
        F.concat(F.lit("**"), letter, F.lit(". "), choice, F.lit("**")), F.concat(letter, F.lit(".")), F.concat(F.lit("Two remain\n"), letter, F.lit(": this one")),
        F.concat(F.lit("see below\nso ("), letter, F.lit(") it is\nend")), choice,
    ]
    pred = F.when(i % 8 == 0, cases[0])
    for k, c in enumerate(cases[1:], 1):
        pred = pred.when(i % 8 == k, c)
    return table(spark, d, "eval_items").select("item_id", "choices", choice.alias("truth"), letter.alias("letter"), pred.otherwise("nothing").alias("pred"))


_LADDER = """coalesce(nullif(regexp_extract(pred, '(?i)(?:Answer|answer):\\s*([A-Za-z0-9]+)', 1), ''), nullif(regexp_extract(pred, '(?i)(?:the\\s+(?:correct\\s+)?answer\\s+is\\s+)([A-D])', 1), ''),
  nullif(regexp_extract(pred, '(?i)\\*\\*([A-D])\\.\\s*[^*]*\\*\\*', 1), ''), nullif(regexp_extract(trim(pred), '(?i)^([A-D])\\.?\\s*$', 1), ''), nullif(regexp_extract(pred, '(?im)^([A-D])[\\.\\:]', 1), ''),
  list_filter(list_transform(list_reverse(string_split(trim(pred), chr(10))[-3:]), lambda x: regexp_extract(x, '(?i)\\b([A-D])\\b', 1)), lambda x: x <> '')[1],
  nullif(regexp_extract(trim(pred), '(?i)([A-D])\\s*$', 1), ''), regexp_extract_all(pred, '(?i)\\b([A-D])\\b', 1)[-1], regexp_split_to_array(trim(pred), '\\s+')[1])"""


@REGISTRY.add(f"""{_PREDICTIONS}, a as (select *, {_LADDER} as answer from p)
  select item_id, answer, coalesce((lower(trim(coalesce(case when upper(answer) in ('A','B','C','D') then choices[ascii(upper(answer)) - 64] end, answer))) = lower(trim(truth)))::double, 0.0) as score from a""")
def t2_answer_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    return p.select("item_id", text.extract_answer(F.col("pred")).alias("answer"), text.answer_accuracy(F.col("pred"), F.col("truth"), F.col("choices")).alias("score"))


_ALL = " , ".join(
    f"regexp_extract_all(pred, '(?im){p}', 1)"
    for p in (r"(?:Answer|answer):\s*([A-Za-z0-9]+)", r"(?:the\s+(?:correct\s+)?answer\s+is\s+)([A-D])", r"\*\*([A-D])\.\s*[^*]*\*\*", r"^([A-D])\.?\s*$", r"^([A-D])[\.\:]", r"\b([A-D])\b", r"([A-D])\s*$")
)


@REGISTRY.add(f"""{_PREDICTIONS}, a as (select *, list_distinct(list_filter(list_transform(flatten([{_ALL}]), lambda x: trim(x)), lambda x: x <> '')) as found from p)
  select item_id, len(found)::int as n, (len(list_filter(found, lambda x: lower(x) = lower(trim(truth)) or coalesce(case when upper(x) in ('A','B','C','D') then lower(trim(choices[ascii(upper(x)) - 64])) end = lower(trim(truth)), false))) > 0)::double as score from a""")
def t4_multi_pattern(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    return p.select("item_id", F.size(text.all_answers(F.col("pred"))).alias("n"), text.multi_pattern_accuracy(F.col("pred"), F.col("truth"), F.col("choices")).alias("score"))


@REGISTRY.add(f"""with s as (select qa_id, {_SET.format("lower(coalesce(expected, ''))")} as a, {_SET.format("lower(coalesce(input, ''))")} as b from qa_dataset),
  c as (select *, len(list_intersect(a, b))::double as k, coalesce(len(list_intersect(a, b)) / nullif(len(a), 0)::double, 0.0) as p, coalesce(len(list_intersect(a, b)) / nullif(len(b), 0)::double, 0.0) as r from s)
  select qa_id, round(p, 6) as precision, round(r, 6) as recall, round(case when k > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from c""")
def t5_token_f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "qa_dataset").select("qa_id", text.token_f1(F.col("expected"), F.col("input")).alias("s")).select("qa_id", "s.*"))


@REGISTRY.add(f"select qa_id, round({jac(w('lower(expected)'), w('lower(input)'))}, 6) as overlap from qa_dataset where expected is not null and input is not null")
def t6_word_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_dataset").where("expected is not null and input is not null")
    return rows.select("qa_id", r6(text.word_jaccard(F.col("expected"), F.col("input"))).alias("overlap"))


_PARAGRAPHS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {st('x')}), lambda x: x <> '')"


@REGISTRY.add(f"""with c as (select doc_id, text, {_PARAGRAPHS} as chunks from documents where text is not null),
  q as (select doc_id, {w("lower(substr(text, 1, 40))")} as q, unnest(chunks) as chunk from c)
  select c.doc_id, round(coalesce(avg({jac('q.q', w('lower(q.chunk)'))}), 0.0), 6) as overlap from c left join q on c.doc_id = q.doc_id group by c.doc_id""")
def t7_chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", r6(text.chunk_overlap(F.substring(t, 1, 40), text.paragraphs(t))).alias("overlap"))


@REGISTRY.add(f"""with c as (select doc_id, {_PARAGRAPHS} as chunks from documents where text is not null),
  u as (select doc_id, unnest(chunks) as x, generate_subscripts(chunks, 1) as i from c),
  d as (select a.doc_id, avg(1 - {jac(w('lower(a.x)'), w('lower(b.x)'))}) as dist from u a join u b on a.doc_id = b.doc_id and a.i < b.i group by 1)
  select c.doc_id, round(case when len(chunks) > 1 then (len(list_distinct(chunks)) / len(chunks)::double + dist) / 2 else 0.0 end, 6) as diversity from c left join d on c.doc_id = d.doc_id""")
def t8_chunk_diversity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", r6(text.chunk_diversity(text.paragraphs(F.col("text")))).alias("diversity"))


@REGISTRY.add(f"""select row_id, case when regexp_matches(lower(agent_response), '\\bwhat is your name\\b|\\bwho are you\\b|\\bwhere are you from\\b|\\bhow old are you\\b|\\bwhat do you do\\b') then 0.3 else 0.7 end::double as retention,
  case when length({st('agent_response')}) < 10 then 0.2 when regexp_matches(lower(agent_response), 'sorry|can''t') then 0.4 else 0.7 end::double as completeness from simple_agent_dataset where agent_response is not null""")
def t9_t10_heuristics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("agent_response")
    return table(spark, d, "simple_agent_dataset").where(c.isNotNull()).select("row_id", text.retention_heuristic(c).alias("retention"), text.completeness_heuristic(c).alias("completeness"))


@REGISTRY.add(f"""with q as (select qa_id, input as q, {w('input')} as w from qa_dataset where input is not null),
  s as (select qa_id, case when len(w) < 3 then 0.3 when len(w) > 20 then 0.8 else 0.6 end as clarity,
    case when regexp_matches(lower(q), 'what|how|why|when|where|who|which') and len(list_filter(w, lambda x: length(x) > 4)) > 1 then 0.9
         when regexp_matches(lower(q), 'what|how|why|when|where|who|which') or len(list_filter(w, lambda x: length(x) > 4)) > 1 then 0.6 else 0.3 end as intent,
    case when array_to_string(w, ' ') = q and length({st('q')}) > 0 then 0.8 else 0.5 end as tidiness,
    least(1.0, 0.5 + case when regexp_matches(lower(q), 'specific|exact|precise|detailed|particular') then 0.2 else 0 end + case when regexp_matches(q, '\\p{{Nd}}') then 0.15 else 0 end
      + case when len(list_filter(w, lambda x: length(x) > 2 and regexp_matches(x, '^\\p{{Lu}}'))) > 0 then 0.15 else 0 end) as specificity,
    case when len(w) = 0 then 0.0 when len(list_distinct(w)) / len(w)::double > 0.8 and list_avg(list_transform(w, lambda x: length(x))) > 6 then 0.9
         when len(list_distinct(w)) / len(w)::double > 0.6 and list_avg(list_transform(w, lambda x: length(x))) > 5 then 0.7 else 0.5 end as complexity,
    1.0 - least(len(list_filter({w('lower(q)')}, lambda x: x in ('it', 'this', 'that', 'these', 'those', 'thing', 'stuff'))) / 3.0, 1.0) as unambiguity from q)
  select qa_id, clarity::double as clarity, intent::double as intent, tidiness::double as tidiness, round(specificity, 6)::double as specificity, complexity::double as complexity, round(unambiguity, 6)::double as unambiguity,
    round(clarity::double * 0.25 + intent::double * 0.25 + tidiness::double * 0.2 + specificity::double * 0.15 + complexity::double * 0.1 + unambiguity::double * 0.05, 6) as quality from s""")
def t11_t17_query_quality(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("input")
    return rounded(
        table(spark, d, "qa_dataset").where(q.isNotNull()).select(
            "qa_id", text.query_clarity(q).alias("clarity"), text.query_intent(q).alias("intent"), text.query_tidiness(q).alias("tidiness"), text.query_specificity(q).alias("specificity"),
            text.query_complexity(q).alias("complexity"), text.query_unambiguity(q).alias("unambiguity"), text.query_quality(q).alias("quality"),
        )
    )


@REGISTRY.add(f"""with p as (select doc_id, text, case when len(string_split(text, chr(10) || chr(10))) > 1 then string_split(text, chr(10) || chr(10)) else regexp_split_to_array(text, '[.!?]+') end as parts from documents where text is not null),
  k as (select *, list_filter(list_transform(parts, lambda x: {st('x')}), lambda x: length(x) >= 50) as kept from p)
  select doc_id, len(case when len(kept) > 0 then kept else [text] end)::int as n, list_sum(list_transform(case when len(kept) > 0 then kept else [text] end, lambda x: length(x)))::bigint as chars from k""")
def t18_context_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = text.context_chunks(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", c.alias("c"))
    return rows.select("doc_id", F.size("c").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


def _lines(x: str) -> str:
    return f"list_transform(string_split({st(x)}, chr(10)), lambda x: {st('x')})"


_ITEMS = f"list_filter({_lines('text')}, lambda x: regexp_matches(x, '^[\\p{{Nd}}*-]'))"


@REGISTRY.add(f"""select doc_id,
  len(list_filter(list_transform({_ITEMS}, lambda x: {st("regexp_replace(x, '^(?:10|[1-9])[.]|^[-*]', '')")}), lambda x: x <> ''))::int as claims,
  len(list_filter(list_transform({_ITEMS}, lambda x: {st("regexp_replace(x, '^[1-5][.]|^[-*]', '')")}), lambda x: x <> '' and ends_with(x, '?')))::int as questions,
  len(list_filter(list_transform(string_split(text, '.'), lambda x: {st('x')}), lambda x: length(x) > 10))::int as sentences,
  case when lower({st('text')}) = 'none' then 0 else len(list_filter(list_transform({_lines('text')}, lambda x: {st("regexp_extract(x, '^[0-9]+[.)]\\s*(.+)$', 1)")}), lambda x: length(x) > 5)) end::int as facts,
  case when starts_with(upper({st('text')}), 'NO') then 0 else len(list_filter(list_transform(string_split({st('text')}, chr(10))[2:], lambda x: {st('x')}), lambda x: x <> '' and not starts_with(upper(x), 'NO'))) end::int as violations
  from documents where text is not null""")
def t19_t24_listed_items(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select(
        "doc_id", F.size(text.numbered_claims(t)).alias("claims"), F.size(text.numbered_questions(t)).alias("questions"), F.size(text.sentence_claims(t)).alias("sentences"),
        F.size(text.numbered_items(t, 5)).alias("facts"), F.size(text.listed_violations(t)).alias("violations"),
    )


@REGISTRY.add("""select item_id::varchar as id, 'Question: ' || question || chr(10) || array_to_string(list_transform(range(1, len(choices) + 1), lambda i: chr((64 + i)::int) || '. ' || choices[i] || chr(10)), '') || 'Answer:' as input,
  choices[answer + 1] as expected, subset as subject from eval_items""")
def pr3_choice_prompts(spark: SparkSession, d: str) -> DataFrame:
    return samples.choice_samples(table(spark, d, "eval_items")).select("id", "input", "expected", "subject")


@REGISTRY.add("select item_id, len(choices)::int as n, answer::int as found from (select item_id, choices, list_position(list_transform(choices, lambda c: lower(trim(c))), lower(trim(choices[answer + 1]))) - 1 as answer from eval_items)")
def pr16_pr17_choices_from_prompt(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    prompt = text.multiple_choice_prompt(F.col("question"), F.col("choices"))
    got = items.select("item_id", F.get("choices", "answer").alias("expected"), text.choices_in(prompt).alias("found_choices"))
    return got.select("item_id", F.size("found_choices").alias("n"), text.choice_index(F.col("expected"), F.col("found_choices")).alias("found"))


# --- judge responses -----------------------------------------------------------------------------------

_RATED = """with r as (select doc_id, text as output, case doc_id % 6 when 0 then 'Rating: ' || (doc_id % 5 + 1) when 1 then 'I would give ' || (doc_id % 5 + 1) || ' of 5' when 2 then 'no number'
  when 3 then '{"bias_score": ' || (doc_id % 5 + 1) || '}' when 4 then 'rating: 4 and 2' else 'Rating: 12 or 3' end as response from documents)"""


def _rated(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    n = (i % 5 + 1).cast("string")
    r = (
        F.when(i % 6 == 0, F.concat(F.lit("Rating: "), n)).when(i % 6 == 1, F.concat(F.lit("I would give "), n, F.lit(" of 5"))).when(i % 6 == 2, "no number")
        .when(i % 6 == 3, F.concat(F.lit('{"bias_score": '), n, F.lit("}"))).when(i % 6 == 4, "rating: 4 and 2").otherwise("Rating: 12 or 3")
    )
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("output"), r.alias("response"))


_LAST = "try_cast(regexp_extract_all(response, '\\b(\\d+)\\b', 1)[-1] as double)"
_NAMED = "try_cast(nullif(regexp_extract(response, 'Rating:\\s*(\\d+)', 1), '') as double)"
_JSON = "case when json_valid(regexp_extract(response, '(?s)\\{.*\\}', 0)) and regexp_matches(response, '(?s)\\{.*\\}') then regexp_extract(response, '(?s)\\{.*\\}', 0) when json_valid(trim(response)) then trim(response) end"


@REGISTRY.add(f"""{_RATED}, v as (select *, coalesce({_NAMED}, {_LAST}, 3.0) as x3, coalesce({_NAMED}, {_LAST}, 1.0) as x1, {_JSON} as j, coalesce({_LAST}, 1.0) as last from r),
  s as (select *, coalesce({st('output')}, '') = '' as blank from v)
  select doc_id, case when blank then 0.0 else round(x3 / 5, 6) end as clarity, case when blank then 0.0 else round((6 - x1) / 5, 6) end as hallucination,
  case when blank then 0.0 else round((6 - case when j is not null then coalesce(try_cast(json_extract_string(j, '$.bias_score') as double), 1.0) else last end) / 5, 6) end as bias,
  case when blank then false else round(x3 / 5, 6) >= 0.7 end as clarity_passed from s""")
def g1_g21_rating_scorers(spark: SparkSession, d: str) -> DataFrame:
    names = {"clarity_and_coherence": "response", "hallucination_detection": "response", "bias_detection": "response"}
    out = generation.with_scores(_rated(spark, d), names, "output")
    return out.select("doc_id", r6("clarity_and_coherence").alias("clarity"), r6("hallucination_detection").alias("hallucination"), r6("bias_detection").alias("bias"), F.col("clarity_and_coherence_passed").alias("clarity_passed"))


_VERDICTS = "list_transform(range(0, (doc_id % 5)::bigint), lambda i: case (doc_id + i) % 4 when 0 then 'SUPPORTED' when 1 then 'partially_supported' when 2 then 'NOT_SUPPORTED' else 'unclear' end)"


@REGISTRY.add(f"""with v as (select doc_id, coalesce({st('text')}, '') = '' as blank, {_VERDICTS} as v from documents),
  s as (select *, list_transform(v, lambda x: case when contains(upper(x), 'PARTIALLY_SUPPORTED') then 0.5 when contains(upper(x), 'NOT_SUPPORTED') then 0.0 when contains(upper(x), 'SUPPORTED') then 1.0 else 0.0 end) as k,
    list_transform(v, lambda x: case when contains(upper(x), 'SUPPORTED') and not contains(upper(x), 'NOT_SUPPORTED') then 1.0 when contains(upper(x), 'PARTIALLY_SUPPORTED') then 0.5 else 0.0 end) as kc from v)
  select doc_id, case when blank then 0.0 when len(v) = 0 then 1.0 else round(list_avg(k)::double, 6) end::double as faithfulness, case when blank then 0.0 when len(v) = 0 then 1.0 else round(list_avg(kc)::double, 6) end::double as as_reference from s""")
def l2_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    at = F.when(i % 5 > 0, F.sequence(F.lit(0), (i % 5 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    kind = lambda k: F.when((i + k) % 4 == 0, "SUPPORTED").when((i + k) % 4 == 1, "partially_supported").when((i + k) % 4 == 2, "NOT_SUPPORTED").otherwise("unclear")
    v = F.transform(at, kind)
    return rounded(table(spark, d, "documents").select("doc_id", generation.faithfulness(v, F.col("text")).alias("faithfulness"), generation.faithfulness(v, F.col("text"), True).alias("as_reference")))


_TALK = """with r as (select qa_id, case qa_id % 8 when 0 then '{"score": ' || (qa_id % 10) || ', "reasoning": "ok"}' when 1 then 'Sure: {"score": 4, "reasoning": "fine"} done' when 2 then '{"score": 3.5}'
  when 3 then '{"score": 7, "reasoning": "cut' when 4 then '8' when 5 then 'about 6 points' when 6 then 'no idea' else '**Reasoning:** good' || chr(10) || '**Final Score:** 4/5' end as response from qa_dataset)"""


def _talk(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("qa_id")
    fixed = {1: 'Sure: {"score": 4, "reasoning": "fine"} done', 2: '{"score": 3.5}', 3: '{"score": 7, "reasoning": "cut', 4: "8", 5: "about 6 points", 6: "no idea", 7: "**Reasoning:** good\n**Final Score:** 4/5"}
    r = F.when(i % 8 == 0, F.concat(F.lit('{"score": '), (i % 10).cast("string"), F.lit(', "reasoning": "ok"}')))
    for k, s in fixed.items():
        r = r.when(i % 8 == k, s)
    return table(spark, d, "qa_dataset").select("qa_id", r.alias("response"))


@REGISTRY.add(f"""{_TALK}, j as (select *, case when contains(response, '{{') and contains(response, '}}') then regexp_extract(response, '(?s)\\{{.*\\}}', 0) else response end as body from r),
  v as (select *, case when json_valid(body) then body end as v from j)
  select qa_id, round(case when v is not null then coalesce(try_cast(json_extract_string(v, '$.score') as double), try_cast(v as double), 1.0) else coalesce(try_cast(nullif(regexp_extract(response, '["'']?score["'']?\\s*:\\s*([0-9.]+)', 1), '') as double),
    try_cast(nullif(regexp_extract(response, '\\b([0-9.]+)\\b', 1), '') as double), 1.0) end, 6) as agent,
  round(case when v is not null and json_extract_string(v, '$.reasoning') is not null and try_cast(json_extract_string(v, '$.score') as double) between 1 and 5 then (try_cast(json_extract_string(v, '$.score') as double) - 1) / 4 else 0.0 end, 6) as panel,
  round(case when contains(response, 'Final Score:**') then 0.75 when len(regexp_extract_all(response, '\\b(\\d+\\.?\\d*)\\b', 1)) = 0 then 0.0 else greatest(0.0, least(1.0, (try_cast(regexp_extract_all(response, '\\b(\\d+\\.?\\d*)\\b', 1)[-1] as double) - 1) / 4)) end, 6)::double as criteria from v""")
def pa_pp_pg_response_parsers(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("response")
    return _talk(spark, d).select("qa_id", r6(responses.agent_score(r)["score"]).alias("agent"), r6(responses.panel_score(r)).alias("panel"), r6(responses.criteria_score(r)).alias("criteria"))


@REGISTRY.add(f"""{_TALK} select qa_id, round(greatest(0.0, least(10.0, coalesce(try_cast(nullif(regexp_extract(response, '(?i)Rating:\\s*(\\d+)', 1), '') as double), try_cast(regexp_extract_all(response, '\\b(\\d+)\\b', 1)[1] as double), 5.0))), 6)::double as rating,
  round(coalesce(try_cast(regexp_extract_all(response, '\\b([1-5])\\b', 1)[1] as double), 3.0), 6)::double as first_of_five from r""")
def r12_ratings(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("response")
    return _talk(spark, d).select("qa_id", r6(responses.rating_of_ten(r)).alias("rating"), r6(responses.rating_or_first(r)).alias("first_of_five"))


@REGISTRY.add(f"""select doc_id, floor(length(text) / 4.0)::bigint as quarter, greatest(1, floor(length(text) / 4.0))::bigint as at_least_one, (2 * len({w('text')}))::bigint as double_words from documents where text is not null""")
def m5_token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", *[text.estimated_tokens(t, k).cast("long").alias(k) for k in ("quarter", "at_least_one", "double_words")])
