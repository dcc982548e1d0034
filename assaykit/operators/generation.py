"""Model-judged scorers of generated answers, as one operator and a table of its settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import responses, text


@dataclass(frozen=True)
class Rating:
    """How a judge's response becomes a score. parse: rating or json:<field>; inverted: (6 - x) / 5 instead of x / 5.

    needs: which inputs must not be blank (else 0); chunks: fewer paragraphs than this give 1; per_item: the
    response is an array, one per claim or chunk, and the mean counts (none gives 1).
    """

    threshold: float
    parse: str = "rating"
    default: float = 3.0
    inverted: bool = False
    needs: tuple[str, ...] = ("output",)
    chunks: int = 0
    per_item: bool = False


_BOTH = ("output", "context")
# Thresholds, fields and defaults of the scorers.
SCORERS: dict[str, Rating] = {
    "bias_detection": Rating(0.8, "json:bias_score", 1.0, inverted=True),
    "factual_accuracy": Rating(0.8, "json:accuracy_score", needs=_BOTH),
    "claim_verification": Rating(0.7, "json:verification_score", per_item=True),
    "information_density": Rating(0.6),
    "clarity_and_coherence": Rating(0.7),
    "conflict_resolution": Rating(0.7, needs=_BOTH, chunks=2),
    "context_prioritization": Rating(0.6, needs=_BOTH),
    "citation_quality": Rating(0.6),
    "tone_consistency": Rating(0.7),
    "terminology_consistency": Rating(0.7),
    "context_faithfulness": Rating(0.8, default=1.0, needs=_BOTH, per_item=True),
    "context_groundedness": Rating(0.7, needs=_BOTH),
    "context_completeness": Rating(0.6, needs=_BOTH),
    "context_consistency": Rating(0.7, needs=_BOTH, chunks=2, per_item=True),
    "answer_quality": Rating(0.7),
    "hallucination_detection": Rating(0.8, default=1.0, inverted=True),
    "source_attribution": Rating(0.6),
    "answer_completeness": Rating(0.7),
    "question_answer_alignment": Rating(0.7),
    "cross_context_synthesis": Rating(0.7, needs=_BOTH, chunks=2),
    "technical_accuracy": Rating(0.8),
}


def _one(spec: Rating, response: Column) -> Column:
    kind, _, field = spec.parse.partition(":")
    x = responses.json_number(response, field, spec.default) if kind == "json" else responses.rating_or_last(response, spec.default)
    return (6 - x) / 5 if spec.inverted else x / 5


def rating_score(name: str, response: Column, output: Column, context: Column | None = None) -> Column:
    """The score of a scorer in SCORERS. response: the judge's text, or an array of texts for scorers per item."""
    spec = SCORERS[name]
    blank = lambda c: F.coalesce(text.strip(c), F.lit("")) == ""
    given = {"output": output, "context": F.lit(None).cast("string") if context is None else context}
    out = F.when(blank(given[spec.needs[0]]), 0.0)
    for n in spec.needs[1:]:
        out = out.when(blank(given[n]), 0.0)
    if spec.chunks and context is not None:
        out = out.when(F.size(text.paragraphs(context)) < spec.chunks, 1.0)
    if spec.per_item:
        return out.when(F.coalesce(F.size(response), F.lit(0)) == 0, 1.0).otherwise(text.mean(F.transform(response, lambda r: _one(spec, r))))
    return out.otherwise(_one(spec, response))


def with_scores(df: DataFrame, scorers: dict[str, str], output: str, context: str | None = None) -> DataFrame:
    """df with `<scorer>` and `<scorer>_passed` for every scorer -> response column."""
    for name, column in scorers.items():
        score = rating_score(name, F.col(column), F.col(output), F.col(context) if context else None)
        df = df.withColumn(name, score).withColumn(f"{name}_passed", F.col(name) >= SCORERS[name].threshold)
    return df


# --- answers against their context ---------------------------------------------------------------------


def faithfulness(verdicts: Column, context: Column, reference_compat: bool = False) -> Column:
    """(supported + half of partial) / claims; no context gives 0, no claims 1. verdicts: one response per claim."""
    weights = F.transform(verdicts, lambda v: responses.verdict_weight(v, "SUPPORTED", "PARTIALLY_SUPPORTED", "NOT_SUPPORTED", reference_compat))
    return F.when(F.coalesce(text.strip(context), F.lit("")) == "", 0.0).when(F.size(verdicts) == 0, 1.0).otherwise(text.mean(weights))


def contextual_recall(verdicts: Column, context: Column, expected: Column, reference_compat: bool = False) -> Column:
    """(present + half of partial) / facts; without context, expected answer or facts 0."""
    weights = F.transform(verdicts, lambda v: responses.verdict_weight(v, "PRESENT", "PARTIALLY_PRESENT", "NOT_PRESENT", reference_compat))
    missing = (F.coalesce(text.strip(context), F.lit("")) == "") | (F.coalesce(text.strip(expected), F.lit("")) == "")
    return F.when(missing, 0.0).otherwise(text.mean(weights))


def contextual_precision(ratings: Column) -> Column:
    """Mean rating / 5 over the context's chunks."""
    return text.mean(F.transform(ratings, lambda r: responses.rating_or_first(r) / 5))


def answer_relevancy(question: Column, generated: Column) -> Column:
    """Mean word overlap of a question with those generated from the answer; none gives 0."""
    return text.chunk_overlap(question, generated)


RAGAS_WEIGHTS = {"faithfulness": 0.25, "answer_relevancy": 0.35, "contextual_precision": 0.2, "contextual_recall": 0.2}
