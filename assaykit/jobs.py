"""Evaluation jobs from a configuration: models x datasets x scorers, aggregated, gated and reported."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import text
from assaykit.operators import aggregates, judging, samples
from assaykit.sources import read_samples, sinks

#: name -> (prediction, truth, choices or None) -> score
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "exact_match": lambda p, t: text.exact_match(p, t),
    "accuracy": lambda p, t: text.answer_accuracy(p, t),
    "multi_pattern_accuracy": lambda p, t: text.multi_pattern_accuracy(p, t),
    "f1": lambda p, t: text.token_f1(p, t)["f1"],
    "word_overlap": lambda p, t: text.word_jaccard(p, t),
    "completeness": lambda p, t: text.completeness_heuristic(p),
}


def register_scorer(name: str, scorer: Callable[[Column, Column], Column]) -> None:
    SCORERS[name] = scorer


@dataclass
class Job:
    """datasets: name -> path; responses: a table (model, prompt, response) that is replayed; call: used where there is none."""

    datasets: dict[str, str]
    models: list[str]
    scorers: list[str]
    responses: str | None = None
    call: Callable[[str], str] | None = None
    output: str | None = None
    fail_below: float = 0.0
    sample: int | None = None
    seed: int = 42
    options: dict = field(default_factory=dict)


def merged(base: dict, extra: dict) -> dict:
    """base with extra put over it, objects key by key."""
    out = dict(base)
    for k, v in extra.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def lookup(config: dict, path: str, default=None):
    """The value at a dotted path."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def load_config(path: str, prefix: str = "ASSAYKIT_") -> dict:
    """JSON, or YAML where a reader is installed; ${NAME} is replaced by the environment, PREFIX_A__B overrides a.b."""
    raw = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), Path(path).read_text())
    if path.endswith((".yml", ".yaml")):
        import yaml

        config = yaml.safe_load(raw)
    else:
        config = json.loads(raw)
    for name, value in os.environ.items():
        if name.startswith(prefix):
            nested: dict | str = value
            for part in reversed(name[len(prefix) :].lower().split("__")):
                nested = {part: nested}
            config = merged(config, nested)
    return config


def evaluate(spark: SparkSession, job: Job) -> DataFrame:
    """Long results (model, dataset, sample_id, input, expected, prediction, scorer, score). Scorers are columns of one projection."""
    unknown = [s for s in job.scorers if s not in SCORERS]
    if unknown or not job.models or not job.datasets:
        raise ValueError(f"unknown scorers: {unknown}" if unknown else "a job needs models and datasets")
    frames = []
    for name, path in job.datasets.items():
        df = samples.canonical(read_samples(spark, path)).select("id", "input", "expected")
        frames.append(samples.choose(df, job.sample, job.seed).withColumn("dataset", F.lit(name)))
    rows = samples.for_models(samples.union_all(frames), job.models).withColumnRenamed("id", "sample_id")
    if job.responses:
        recorded = spark.read.parquet(job.responses)
        answered = recorded.groupBy("model", F.col("prompt").alias("input")).agg(F.min("response").alias("prediction"))
        rows = rows.join(answered, ["model", "input"], "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))
    elif job.call:
        rows = judging.generate(rows, job.call, "input", "prediction")
    else:
        raise ValueError("a job needs recorded responses or a call")
    p, t = F.col("prediction"), F.col("expected")
    scored = F.array(*[F.struct(F.lit(s).alias("scorer"), SCORERS[s](p, t).cast("double").alias("score")) for s in job.scorers])
    return rows.select("model", "dataset", "sample_id", "input", "expected", "prediction", F.inline(scored))


def run(spark: SparkSession, job: Job) -> dict:
    """Evaluate, write the facts once, and return the gate's row; with an output folder also summaries and reports."""
    facts = evaluate(spark, job)
    if job.output:
        facts.write.mode("overwrite").parquet(f"{job.output}/samples")
        facts = spark.read.parquet(f"{job.output}/samples")
    summary = aggregates.describe_scores(facts, ["model", "dataset", "scorer"])
    verdict = aggregates.gate(summary.withColumnRenamed("mean", "score"), job.fail_below).first().asDict()
    if job.output:
        summary.write.mode("overwrite").parquet(f"{job.output}/summary")
        out = Path(job.output)
        failing = F.coalesce("mean", F.lit(0.0)) < job.fail_below
        (out / "report.html").write_text(sinks.report_html(summary, "Evaluation", failing=failing))
        (out / "report.md").write_text(sinks.report_markdown(summary, failing=failing))
        named = summary.select(F.concat_ws(" / ", "model", "dataset", "scorer").alias("name"), "mean")
        (out / "report.xml").write_text(sinks.report_junit(named, "name", "mean", job.fail_below))
        (out / "verdict.json").write_text(json.dumps(verdict))
    return verdict


def main(argv: list[str] | None = None) -> int:
    """assaykit.jobs CONFIG: run a job; the exit code is 1 if its gate fails."""
    argv = sys.argv[1:] if argv is None else argv
    if len(argv) != 1:
        print(main.__doc__)
        return 2
    config = load_config(argv[0])
    job = Job(**{k: v for k, v in config.items() if k in Job.__dataclass_fields__})
    verdict = run(SparkSession.builder.getOrCreate(), job)
    print(json.dumps(verdict))
    return int(not verdict["passed"])


if __name__ == "__main__":
    sys.exit(main())
