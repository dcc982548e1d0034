"""Stage metrics of retrieval pipelines: rows (sample_id, stage_name, latency_ms, success)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Critical stages and weights.
CRITICAL = ("query_processing", "retrieval", "generation")
RETRIEVAL_WEIGHTS = {"precision": 0.25, "recall": 0.25, "f1": 0.2, "ranking": 0.15, "similarity": 0.1, "diversity": 0.05}
GENERATION_WEIGHTS = {
    "factual_accuracy": 0.15, "claim_verification": 0.12, "hallucination_detection": 0.12, "answer_completeness": 0.10, "question_answer_alignment": 0.10, "information_density": 0.08,
    "clarity_and_coherence": 0.08, "citation_quality": 0.06, "source_attribution": 0.06, "bias_detection": 0.05, "tone_consistency": 0.04, "terminology_consistency": 0.04,
}
#: A stage succeeded from this score on.
STAGE_PASSES = 0.6
OVERALL_WEIGHTS = {"retrieval": 0.3, "generation": 0.4, "coordination": 0.2, "error_handling": 0.1}


def stage_metrics(stages: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row per sample: coordination, latency band, use of resources, error handling and their parts.

    Coordination: mean of success share, 1 - std / mean of latencies (not below 0), and share of latencies from
    10 to 10000. Resources: share of fast successes, success share, their mean, and the mean of the three.
    Errors: mean of isolation (1 - failed / n) and recovery (1, 0.5 or 0 for none, one, more failed critical stages).
    """
    x, ok, n = F.col("latency_ms"), F.coalesce(F.col("success"), F.lit(False)), F.count(F.lit(1))
    steady = F.when(F.avg(x) > 0, F.greatest(F.lit(0.0), 1 - F.stddev_pop(x) / F.avg(x))).otherwise(0.0)
    failed_critical = F.count_if(~ok & F.col("stage_name").isin(*CRITICAL))
    total = F.coalesce(F.sum(x), F.lit(0.0))
    out = stages.groupBy(key).agg(
        n.alias("stages"), (F.count_if(ok) / n).alias("success_rate"), steady.alias("latency_consistency"), (F.count_if(x.between(10, 10000)) / n).alias("reasonable_share"),
        total.alias("total_latency"), F.avg(x).alias("avg_latency"), F.max(x).alias("max_latency"), (F.count_if(ok & (x < 1000)) / n).alias("cpu"), (1 - F.count_if(~ok) / n).alias("isolation"),
        F.when(failed_critical == 0, 1.0).when(failed_critical == 1, 0.5).otherwise(0.0).alias("recovery"),
    )
    memory, cpu = F.col("success_rate"), F.col("cpu")
    efficiency = (cpu + memory) / 2
    return (
        out.withColumn("coordination", (F.col("success_rate") + F.col("latency_consistency") + F.col("reasonable_share")) / 3)
        .withColumn("latency_score", latency_band(F.col("total_latency")))
        .withColumn("efficiency", efficiency).withColumn("resources", (cpu + memory + efficiency) / 3)
        .withColumn("error_handling", (F.col("isolation") + F.col("recovery")) / 2)
    )


def latency_band(total_ms: Column) -> Column:
    return F.when(total_ms < 1000, 0.9).when(total_ms < 5000, 0.7).when(total_ms < 10000, 0.5).otherwise(0.2)


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of parts times weights; missing parts are 0 and weights stay as they are."""
    total = F.lit(0.0)
    for name, w in weights.items():
        if name in parts:
            total = total + F.coalesce(parts[name], F.lit(0.0)) * w
    return total


def retrieval_stage(parts: dict[str, Column]) -> Column:
    """Score of a retrieval stage of the parts named in RETRIEVAL_WEIGHTS."""
    return weighted(parts, RETRIEVAL_WEIGHTS)


def generation_stage(parts: dict[str, Column]) -> Column:
    """Score of a generation stage of the scorers named in GENERATION_WEIGHTS."""
    return weighted(parts, GENERATION_WEIGHTS)


def succeeded(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.0)) >= STAGE_PASSES


def overall(retrieval: Column, generation: Column, coordination: Column, error_handling: Column) -> Column:
    return weighted({"retrieval": retrieval, "generation": generation, "coordination": coordination, "error_handling": error_handling}, OVERALL_WEIGHTS)


def recommendations(score: Column, slowest_ms: Column, failed: Column, coordination: Column, resources: Column) -> Column:
    """Texts for what stands out: failed stages, slow ones, a low score, poor coordination, poor use of resources."""
    found = F.array(
        F.when(failed > 0, "look into the stages that failed"), F.when(slowest_ms > 2000, "speed up the slowest stage"), F.when(score < 0.6, "raise the quality of the weakest stage"),
        F.when(coordination < 0.7, "align the stages with each other"), F.when(resources < 0.6, "make better use of resources"),
    )
    return F.filter(found, lambda x: x.isNotNull())
