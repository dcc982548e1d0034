"""Conversation scorers over turns (conv_id, turn, role, text); responses of a judge are a column or a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions import responses, text
from assaykit.operators.aggregates import known

THRESHOLD = 0.7


def context_window(turns: DataFrame, width: int = 5, current: bool = False, role: str | None = None, out: str = "window") -> DataFrame:
    """turns with an array of (turn, role, text) of the `width` turns before, and the current one if asked; of one role if named.

    The frame is bounded, so a long conversation is streamed through a window of `width` rows.
    """
    frame = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-width, 0 if current else -1)
    items = F.collect_list(F.struct("turn", "role", "text")).over(frame)
    return turns.withColumn(out, F.filter(items, lambda x: x["role"] == role) if role else items)


def relevancy(turn_text: Column, window: Column, response: Column) -> Column:
    """Rating / 5 where there is a window, else the word overlap with the text judged against; blank text gives 0."""
    rating = responses.rating_or_first(response, named=False) / 5
    return F.when(text.strip(turn_text) == "", 0.0).when(F.size(window) > 0, rating).otherwise(0.0)


def fallback_relevancy(pred: Column, truth: Column) -> Column:
    return F.when(text.strip(pred) == "", 0.0).otherwise(text.word_jaccard(pred, truth))


def retention(knowledge: Column, violations: Column) -> Column:
    """1 - violations / knowledge items, not below 0; nothing known gives 1. Both are judge responses."""
    items, broken = F.size(text.numbered_items(knowledge, 5)), F.size(text.listed_violations(violations))
    return F.when(items > 0, F.greatest(F.lit(0.0), 1 - broken / items)).otherwise(1.0)


def completeness(intentions: Column, ratings: Column, has_assistant: Column) -> Column:
    """Mean of ratings / 5 over the intentions; none gives 1, no assistant turn 0. ratings: responses, one per intention."""
    n = F.size(text.numbered_items(intentions))
    scores = F.transform(ratings, lambda r: responses.rating_or_first(r, named=False) / 5)
    return F.when(~has_assistant, 0.0).when(n == 0, 1.0).otherwise(text.mean(scores))


def role_adherence(role: Column, response: Column) -> Column:
    """Rating / 5; without a role 1."""
    return F.when(F.coalesce(text.strip(role), F.lit("")) == "", 1.0).otherwise(responses.rating_or_first(response, named=False) / 5)


def combined(parts: dict[str, Column]) -> Column:
    """Unweighted mean of the metrics that are enabled."""
    total = F.lit(0.0)
    for c in parts.values():
        total = total + F.coalesce(known(c), F.lit(0.0))
    return total / len(parts) if parts else F.lit(0.0)


def by_role(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, users, assistants, user_text, assistant_text): a conversation's turns by role, in order.

    The texts of one conversation are gathered; a conversation is the unit that is judged.
    """
    ordered = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"),
        F.array_join(ordered("user"), "\n").alias("user_text"), F.array_join(ordered("assistant"), "\n").alias("assistant_text"),
    )
