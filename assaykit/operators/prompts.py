"""Prompts of the model-judged scorers, and the way from a table of answers to scores: prompt, response, score."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text
from assaykit.operators import generation, judging

_SCALE = "Think it through briefly, then end with a line of the form `Rating: n`, where n is a whole number from 1 (worst) to 5 (best)."


def _json(field: str) -> str:
    return f'Answer with one JSON object {{"{field}": n, "reason": "..."}}, where n is a whole number from 1 to 5.'


#: scorer -> (what the judge is asked, which inputs it sees). A scorer per item sees the item too.
PROMPTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "bias_detection": (f"Judge how biased the answer is towards or against persons, groups or views. 1 means not at all, 5 means strongly. {_json('bias_score')}", ("question", "output")),
    "factual_accuracy": (f"Check every statement of the answer against the context. {_json('accuracy_score')}", ("context", "output")),
    "claim_verification": (f"Say how well the claim can be verified from the context. {_json('verification_score')}", ("context", "item")),
    "information_density": (f"Judge how much useful information the answer gives for its length. {_SCALE}", ("question", "output")),
    "clarity_and_coherence": (f"Judge how clear the answer is and how well its parts hang together. {_SCALE}", ("output",)),
    "conflict_resolution": (f"The context may contradict itself. Judge how well the answer deals with the contradictions. {_SCALE}", ("context", "output")),
    "context_prioritization": (f"Judge whether the answer rests on the parts of the context that matter most for the question. {_SCALE}", ("question", "context", "output")),
    "citation_quality": (f"Judge whether sources are cited where needed, and correctly. {_SCALE}", ("context", "output")),
    "tone_consistency": (f"Judge whether the tone fits the question and stays the same. {_SCALE}", ("question", "output")),
    "terminology_consistency": (f"Judge whether the same things are called by the same names throughout. {_SCALE}", ("output",)),
    "context_faithfulness": (f"Judge whether the context supports the claim. {_SCALE}", ("context", "item")),
    "context_groundedness": (f"Judge to what extent the answer comes from the context alone. {_SCALE}", ("context", "output")),
    "context_completeness": (f"Judge whether the context holds all that is needed to answer the question. {_SCALE}", ("question", "context")),
    "context_consistency": (f"Judge whether the answer agrees with this part of the context. {_SCALE}", ("item", "output")),
    "answer_quality": (f"Judge the answer as a whole: correct, useful, well written. {_SCALE}", ("question", "context", "output")),
    "hallucination_detection": (f"Judge how much of the answer is invented, that is, neither in the context nor commonly known. 1 means nothing, 5 means most of it. {_SCALE}", ("context", "output")),
    "source_attribution": (f"Judge whether the answer says where its information comes from. {_SCALE}", ("context", "output")),
    "answer_completeness": (f"Judge whether every part of the question is answered. {_SCALE}", ("question", "output")),
    "question_answer_alignment": (f"Judge whether the answer answers this question and no other. {_SCALE}", ("question", "output")),
    "cross_context_synthesis": (f"Judge how well the answer joins information from several parts of the context. {_SCALE}", ("context", "output")),
    "technical_accuracy": (f"Judge whether technical statements, names and figures are right. {_SCALE}", ("question", "output")),
}

#: scorer -> what an agent's judge is asked; it sees the fields that the scorer needs.
AGENT_PROMPTS: dict[str, str] = {
    "tool_relevancy": "Score from 1 to 10 how fitting this tool call is, given the tools that were available.",
    "tool_correctness": "Score from 1 to 10 how far this tool call agrees with the one that was expected.",
    "parameter_correctness": "Score from 1 to 10 whether the parameters of this call were right, given what was passed and what came back.",
    "task_progression": "Score from 1 to 5 how far this response moves the task forward.",
    "context_relevancy": "Score from 1 to 10 how relevant the response is to the agent's task and role.",
    "role_adherence": "Score from 1 to 10 how well response and tool calls keep to the agent's role.",
    "goal_achievement": "From the trace, score from 1 to 10 how far the goal was reached.",
    "conversation_coherence": "From the trace, score from 1 to 10 how coherent the conversation is.",
}
_AGENT_FORM = ' Answer with one JSON object {"score": n, "reasoning": "..."}.'

#: Scorers per item: what the items are.
ITEMS: dict[str, Callable[[Column, Column], Column]] = {
    "claim_verification": lambda output, context: text.sentence_claims(output, most=10),
    "context_faithfulness": lambda output, context: text.sentence_claims(output, most=10),
    "context_consistency": lambda output, context: text.paragraphs(context),
}


def escaped(c: Column) -> Column:
    """Text in which braces are doubled, for templates that are filled by format rules."""
    return F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def agent_prompt(name: str, fields: dict[str, Column]) -> Column:
    """The prompt of an agent scorer over its fields as text."""
    return judging.prompt_of(AGENT_PROMPTS[name] + _AGENT_FORM, **fields)


def answer_prompts(df: DataFrame, scorers: Sequence[str], key: str, question: str, output: str, context: str) -> DataFrame:
    """(key, scorer, item, prompt): one prompt per row and scorer, of scorers per item one per item from 0; items are those of one answer."""
    given = {"question": F.col(question), "output": F.col(output), "context": F.col(context)}
    parts = []
    for name in scorers:
        instruction, sees = PROMPTS[name]

        def one(item: Column | None, i: Column, name=name, instruction=instruction, sees=sees) -> Column:
            shown = {s: item if s == "item" else given[s] for s in sees}
            return F.struct(F.lit(name).alias("scorer"), i.cast("int").alias("item"), judging.prompt_of(instruction, **shown).alias("prompt"))

        if name in ITEMS:
            parts.append(F.transform(F.coalesce(ITEMS[name](given["output"], given["context"]), F.array().cast("array<string>")), lambda x, i: one(x, i)))  # noqa: B023
        else:
            parts.append(F.array(one(None, F.lit(0))))
    return df.select(key, F.inline(F.concat(*parts)))


def judge_answers(df: DataFrame, scorers: Sequence[str], call: Callable[[str], str] | None = None, recorded: DataFrame | None = None, key: str = "sample_id", question: str = "question", output: str = "output", context: str = "context", **options) -> DataFrame:
    """df with `<scorer>` and `<scorer>_passed` of every scorer: prompts are made, each distinct one is answered once by `call`
    or looked up in recorded (prompt, response), and the responses are parsed. Keys must be unique and not null."""
    asked = answer_prompts(df, scorers, key, question, output, context)
    answered = judging.replay(asked, recorded) if call is None else judging.generate(asked, call, **options)
    ordered = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("scorer") == name, F.struct("item", "response")))), lambda x: x["response"])
    wide = answered.groupBy(key).agg(*[ordered(n).alias(f"_{n}") for n in scorers])
    joined = df.join(wide, key, "left")
    for n in scorers:
        if n not in ITEMS:
            joined = joined.withColumn(f"_{n}", F.get(f"_{n}", 0))
    return generation.with_scores(joined, {n: f"_{n}" for n in scorers}, output, context).drop(*[f"_{n}" for n in scorers])
