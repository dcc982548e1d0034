"""Aggregating scores: by task, user or agent, by model, over panels, and comparing runs.

One aggregation computes all (function, score) pairs, so the fact table is read and shuffled once.
NaN counts as missing throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.session import cut

KEYS = ("user_id", "task_id", "turn_id", "agent_name")

#: Aggregates by name. A group without scores gives 0.0.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "max": F.max, "min": F.min, "median": F.median, "sum": F.sum, "std": F.stddev_samp,
    "range": lambda c: F.max(c) - F.min(c), "count": lambda c: F.count(c).cast("double"),
}


def known(c: Column) -> Column:
    """A double that is null where it was NaN or no number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def score_columns(df: DataFrame, keys: Sequence[str] = KEYS) -> list[str]:
    """All columns that are neither keys nor reasoning."""
    return [c for c in df.columns if c not in keys and not c.endswith("_reasoning")]


def grouped_callable(name: str, f: Callable[[list[float]], float]) -> Callable[[Column], Column]:
    """An aggregate of any list -> float function, run per group as an Arrow function. Its group is held in memory."""

    @F.pandas_udf(T.DoubleType())
    def run(values: pd.Series) -> float:
        return float(f(values.dropna().tolist()))

    run.__name__ = name
    return lambda c: run(c)


def aggregate_by(
    df: DataFrame, key: str, functions: Sequence[str] | dict[str, Callable[[Column], Column]] = ("mean",), scores: Sequence[str] | None = None,
) -> DataFrame:
    """(key, {function}_{score}...): every function of every score column by key.

    Rows with a null key are left out; scores that are no numbers count as missing; a group without scores
    gives 0.0. Repeated rows count each time.
    """
    chosen = functions if isinstance(functions, dict) else {n: FUNCTIONS[n] for n in functions}
    names = list(scores) if scores is not None else score_columns(df)
    aggs = [F.coalesce(f(known(F.col(f"`{s}`"))), F.lit(0.0)).alias(f"{n}_{s}") for n, f in chosen.items() for s in names]
    return df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(*aggs)


def describe_scores(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mean, count, min, max, std) of `score`; the sample deviation of a single score is 0."""
    x = known(F.col("score"))
    return long.groupBy(*by).agg(
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.count(x).alias("count"), F.coalesce(F.min(x), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(x), F.lit(0.0)).alias("max"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
    )


def main_value(score: Column, fields: Sequence[str]) -> Column:
    """The value that stands for a struct of numbers: its `score`, else its first field that is one, else 0.0."""
    order = (["score"] if "score" in fields else []) + [f for f in fields if f != "score"]
    return F.coalesce(*[known(score.getField(f)) for f in order], F.lit(0.0))


def model_summary(long: DataFrame) -> DataFrame:
    """(scorer, mean_of_models, min, max, samples): unweighted mean of the models' means over long (model, sample_id, scorer, score)."""
    per_model = long.groupBy("scorer", "model").agg(F.avg(known(F.col("score"))).alias("m"))
    samples = long.groupBy("scorer").agg(F.count_distinct("sample_id").alias("samples"))
    return (
        per_model.groupBy("scorer").agg(F.avg("m").alias("mean_of_models"), F.min("m").alias("min"), F.max("m").alias("max"))
        .join(samples, "scorer").select("scorer", "mean_of_models", "min", "max", "samples")
    )


def run_totals(long: DataFrame, errors: DataFrame) -> DataFrame:
    """One row over long (model, sample_id, scorer, score) and errors (model, ...): models, distinct samples, scorers and errors."""
    counts = long.agg(F.count_distinct("model").alias("total_models"), F.count_distinct("sample_id").alias("total_samples"), F.count_distinct("scorer").alias("total_scorers"))
    return counts.join(F.broadcast(errors.agg(F.count(F.lit(1)).alias("total_errors"))))  # a single row each


def best_models(long: DataFrame) -> DataFrame:
    """(scorer, model, mean): the model of the greatest mean; of equal ones the first by name."""
    means = long.groupBy("scorer", "model").agg(F.avg(known(F.col("score"))).alias("mean"))
    rank = F.row_number().over(W.partitionBy("scorer").orderBy(F.col("mean").desc_nulls_last(), "model"))
    return means.withColumn("r", rank).where("r = 1").drop("r")


# --- panels --------------------------------------------------------------------------------------------


def panel(votes: DataFrame, key: str = "sample_id", threshold: float = 0.5) -> DataFrame:
    """One row per sample of votes (key, judge, weight, score) with all seven ways to combine them and the consensus level.

    Majority is strict. Consensus is the least score if all reach the threshold, else 0. Weights that sum to
    0 give the mean. The level is 1 - sample deviation / 0.5, not below 0; a single vote agrees with itself.
    """
    s, w = known(F.col("score")), F.col("weight")
    n = F.count(s)
    weights = F.sum(F.when(s.isNotNull(), w))
    return votes.groupBy(key).agg(
        F.coalesce(F.avg(s), F.lit(0.0)).alias("mean"),
        F.coalesce(F.median(s), F.lit(0.0)).alias("median"),
        F.coalesce(F.when(weights != 0, F.sum(s * w) / weights).otherwise(F.avg(s)), F.lit(0.0)).alias("weighted_mean"),
        (F.count_if(s >= threshold) > n / 2).cast("double").alias("majority"),
        F.coalesce(F.when(F.min(s) >= threshold, F.min(s)).otherwise(0.0), F.lit(0.0)).alias("consensus"),
        F.coalesce(F.min(s), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(s), F.lit(0.0)).alias("max"),
        F.when(F.count(s) > 1, F.greatest(F.lit(0.0), 1 - F.stddev_samp(s) / 0.5)).otherwise(1.0).alias("consensus_level"),
    )


def repeated_judgements(runs: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, score, confidence): mean of repeated judgements; confidence 1 - population variance, 0.8 for one."""
    s = known(F.col("score"))
    confidence = F.when(F.count(s) > 1, F.greatest(F.lit(0.0), 1 - F.var_pop(s))).otherwise(0.8)
    return runs.groupBy(key).agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("score"), confidence.alias("confidence"))


def weighted_composite(parts: dict[str, float], missing: str = "zero") -> Column:
    """Weighted mean of metric columns. A missing part counts as 0, or, with missing="skip", in neither sum."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, weight in parts.items():
        c = known(F.col(name))
        top = top + F.coalesce(c, F.lit(0.0)) * weight
        bottom = bottom + (F.when(c.isNotNull(), weight).otherwise(0.0) if missing == "skip" else F.lit(weight))
    return F.when(bottom != 0, top / bottom).otherwise(0.0)


# --- gates and run comparison --------------------------------------------------------------------------


def gate(results: DataFrame, fail_below: float, score: str = "score") -> DataFrame:
    """One row: (failed, total, passed, verdict); a missing score counts as 0."""
    s = F.coalesce(known(F.col(score)), F.lit(0.0))
    row = results.agg(F.count_if(s < fail_below).alias("failed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.bool_and(s >= fail_below), F.lit(True)).alias("passed"))
    return row.withColumn("verdict", F.when(F.col("passed"), "deploy").otherwise("do not deploy"))


def job_summary(results: DataFrame) -> DataFrame:
    """One row over results (model, dataset, score)."""
    s = known(F.col("score"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.agg(
        F.count_distinct("model").alias("models"), F.count_distinct("dataset").alias("datasets"),
        zero(F.avg(s)).alias("avg_score"), zero(F.min(s)).alias("min_score"), zero(F.max(s)).alias("max_score"),
    )


def score_diff(old: DataFrame, new: DataFrame, key: str = "sample_id", extra: Sequence[str] = ()) -> DataFrame:
    """(key, extra, original_score, new_score, difference) of samples whose scores differ, also where one is missing."""
    a = old.select(key, *extra, known(F.col("score")).alias("original_score"))
    b = new.select(key, *extra, known(F.col("score")).alias("new_score"))
    joined = a.join(b, [key, *extra], "full").where(~F.col("original_score").eqNullSafe(F.col("new_score")))
    return joined.withColumn("difference", F.coalesce("new_score", F.lit(0.0)) - F.coalesce("original_score", F.lit(0.0)))


def diff_summary(diff: DataFrame, by: str) -> DataFrame:
    return diff.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("difference")).alias("total"))


def subset_means(detail: DataFrame, by: str = "subset", score: str = "score") -> DataFrame:
    """Mean per subset and, under a null subset, over all; scores that are no numbers count as missing."""
    return detail.rollup(by).agg(F.avg(known(F.col(score))).alias("mean"), F.count(known(F.col(score))).alias("n"))


def run_performance(detail: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, correct, accuracy, token_mean, token_std, cost_mean, cost_std) over detail (score, tokens, cost); MEAN rows are no samples."""
    if "sample_id" in detail.columns:
        detail = detail.where(~F.col("sample_id").eqNullSafe(F.lit("MEAN")))
    s, t, c = known(F.col("score")), known(F.col("tokens")), known(F.col("cost"))
    return detail.groupBy(*by).agg(
        F.count(s).alias("n"), F.coalesce(F.sum(s), F.lit(0.0)).alias("correct"), F.avg(s).alias("accuracy"),
        F.avg(t).alias("token_mean"), F.stddev_samp(t).alias("token_std"), F.avg(c).alias("cost_mean"), F.stddev_samp(c).alias("cost_std"),
    )


def difficulty(means: DataFrame, by: str = "subset", score: str = "accuracy") -> DataFrame:
    """(by, difficulty, std, n) of groups with more than one run; population deviation."""
    s = known(F.col(score))
    return means.groupBy(by).agg((1 - F.avg(s)).alias("difficulty"), F.stddev_pop(s).alias("std"), F.count(s).alias("n")).where("n > 1")


def consistency(means: DataFrame, by: str, score: str = "accuracy") -> DataFrame:
    """(by, mean, std, cv, range, n): coefficient of variation, infinite where the mean is not positive; groups of more than one."""
    s = known(F.col(score))
    out = means.groupBy(by).agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), (F.max(s) - F.min(s)).alias("range"), F.count(s).alias("n")).where("n > 1")
    return out.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(float("inf"))))


def ranked(means: DataFrame, by: str = "subset", model: str = "model", score: str = "accuracy") -> DataFrame:
    """means with `rank` within each group, the greatest score first; ties by model."""
    return means.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), model)))


def outliers(means: DataFrame, score: str = "accuracy", limit: float = 1.96) -> DataFrame:
    """Rows whose z-score exceeds the limit, with z and kind. Mean and deviation are one aggregated row, joined back."""
    s = known(F.col(score))
    stats = means.agg(F.avg(s).alias("_m"), F.stddev_pop(s).alias("_d"))
    z = F.when(F.col("_d") > 0, (s - F.col("_m")) / F.col("_d")).otherwise(0.0)
    out = means.join(F.broadcast(stats)).withColumn("z", z).drop("_m", "_d")  # a single row
    return out.where(F.abs("z") > limit).withColumn("kind", F.when(F.col("z") > 0, "high").otherwise("low"))


def average_ranks(df: DataFrame, col: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """df with ranks of `col` in which ties share their mean rank; null values and keys have none.

    The distinct values with their counts are split by range; ranks within a part are moved by the counts of
    the parts before it. So neither ties nor a large group gather in one task.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    parts = cut(counts.repartitionByRange(*by, col).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_t").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.groupBy(*by, "_part").agg(F.sum("_n").alias("_t")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_t")
    within = F.sum("_n").over(W.partitionBy(*by, "_part").orderBy(col).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranks = parts.withColumn("_within", within).join(starts, [*by, "_part"])
    ranks = ranks.select(*by, col, (F.col("_before") + F.col("_within") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, [*by, col], "left")


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: (n, pearson, spearman); null unless both vary over more than one row."""
    both = df.select(known(F.col(x)).alias("x"), known(F.col(y)).alias("y")).where("x is not null and y is not null")
    both = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
    varies = (F.count(F.lit(1)) > 1) & (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    # corr itself divides by zero where a column does not vary.
    r = lambda a, b: F.when(varies, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))
    return both.agg(F.count(F.lit(1)).alias("n"), r("x", "y").alias("pearson"), r("rx", "ry").alias("spearman"))


def equal_width_bins(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, mean, n): mean of y in bins of x that are closed on the right; the least x is in the first."""
    v = known(F.col(x))
    stats = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(width > 0, F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.round((v - F.col("_lo")) / width, 9))))).otherwise(F.lit(1))
    rows = df.join(F.broadcast(stats)).where(v.isNotNull()).withColumn("bin", b.cast("int"))  # a single row
    return rows.groupBy("bin").agg(F.avg(known(F.col(y))).alias("mean"), F.count(F.lit(1)).alias("n"))
