"""Calling models and judges.

The only step that leaves Spark is the call itself; it is replaced by a join to recorded responses where
there are any. Prompts are made distinct before they are sent, and answers joined back.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import responses
from assaykit.operators import aggregates
from assaykit.session import cut

#: Criteria presets: what is judged, and how many times.
CRITERIA = {"correctness": "factual correctness", "relevance": "relevance to the question", "coherence": "logical order and flow", "helpfulness": "use to the person who asked"}


def prompt_of(instruction: str, **parts: Column) -> Column:
    """An instruction followed by labelled parts; null parts are empty."""
    pieces = [F.lit(instruction)]
    for name, c in parts.items():
        pieces += [F.lit(f"\n\n{name.replace('_', ' ').capitalize()}:\n"), F.coalesce(c, F.lit(""))]
    return F.concat(*pieces)


def replay(df: DataFrame, recorded: DataFrame, prompt: str = "prompt", out: str = "response") -> DataFrame:
    """df with the recorded response (prompt, response) of each prompt; '' where none is recorded.

    Recorded prompts that occur more than once give the least response. The join is on hash and text; a hot
    prompt is spread by adaptive execution.
    """
    known = recorded.groupBy(F.col("prompt").alias("_p")).agg(F.min("response").alias(out))
    return df.join(known, F.col(prompt) == F.col("_p"), "left").withColumn(out, F.coalesce(out, F.lit(""))).drop("_p")


def generate(df: DataFrame, call: Callable[[str], str], prompt: str = "prompt", out: str = "response", retries: int = 5, wait: float = 1.0, errors: str = "raise") -> DataFrame:
    """df with `call(prompt)`; each distinct prompt is sent once. A call that raises TimeoutError or ConnectionError is
    repeated with waits that grow by a quarter, then gives ''; other errors are raised, or give '' with errors="empty".
    Null prompts give ''."""
    if errors not in ("raise", "empty"):
        raise ValueError(errors)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for text in batch["p"]:
                pause, answer = wait, ""
                for _ in range(retries + 1):
                    try:
                        answer = call(text)
                        break
                    except (TimeoutError, ConnectionError):
                        time.sleep(pause)
                        pause *= 1.25
                    except Exception:
                        if errors == "raise":
                            raise
                        break
                answers.append(answer)
            yield pd.DataFrame({"prompt": batch["p"], "response": answers})

    distinct = df.select(F.col(prompt).alias("p")).where("p is not null").distinct()
    answered = cut(distinct.mapInPandas(send, "prompt string, response string"))  # else a retry of a task would call again
    return replay(df, answered, prompt, out)


def iterations(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, with `iteration` from 1."""
    return df.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(n))))


def criteria_scores(responses_: DataFrame, key: str = "sample_id", low: float = 1.0, high: float = 5.0) -> DataFrame:
    """(key, score, confidence) of repeated criteria judgements (key, response)."""
    return aggregates.repeated_judgements(responses_.select(key, responses.criteria_score(F.col("response"), low, high).alias("score")), key)


def panel_of(spark: SparkSession, kind: str, judges: list[str]) -> DataFrame:
    """(judge, weight): diverse and consensus panels weigh alike, experts by their order."""
    weights = [float(len(judges) - i) if kind == "experts" else 1.0 for i in range(len(judges))]
    total = sum(weights) or 1.0
    return spark.createDataFrame([(j, w / total) for j, w in zip(judges, weights, strict=True)], "judge string, weight double")


def panel_results(judged: DataFrame, judges: DataFrame, key: str = "sample_id", threshold: float = 0.5, require_consensus: float | None = None) -> DataFrame:
    """Panel aggregates of responses (key, judge, response). A panel is a short list and is broadcast.

    require_consensus: below this level every combined score is 0.
    """
    votes = judged.join(F.broadcast(judges), "judge").withColumn("score", responses.panel_score(F.col("response")))
    out = aggregates.panel(votes, key, threshold)
    if require_consensus is not None:
        for c in ("mean", "median", "weighted_mean", "majority", "consensus", "min", "max"):
            out = out.withColumn(c, F.when(F.col("consensus_level") >= require_consensus, F.col(c)).otherwise(0.0))
    return out
