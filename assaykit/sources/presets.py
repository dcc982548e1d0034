"""Samples of well-known public datasets from their Parquet exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.samples import canonical

# The input column of each task of the general language understanding benchmark.
GLUE_INPUT = {
    "cola": "sentence", "sst2": "sentence", "mrpc": "sentence1", "qqp": "question1", "stsb": "sentence1", "mnli": "premise", "qnli": "question", "rte": "sentence1", "wnli": "sentence1",
}

# The subjects of the massive multitask benchmark.
SUBJECTS = tuple(
    """abstract_algebra anatomy astronomy business_ethics clinical_knowledge college_biology college_chemistry college_computer_science college_mathematics
    college_medicine college_physics computer_security conceptual_physics econometrics electrical_engineering elementary_mathematics formal_logic global_facts
    high_school_biology high_school_chemistry high_school_computer_science high_school_european_history high_school_geography high_school_government_and_politics
    high_school_macroeconomics high_school_mathematics high_school_microeconomics high_school_physics high_school_psychology high_school_statistics
    high_school_us_history high_school_world_history human_aging human_sexuality international_law jurisprudence logical_fallacies machine_learning management
    marketing medical_genetics miscellaneous moral_disputes moral_scenarios nutrition philosophy prehistory professional_accounting professional_law
    professional_medicine professional_psychology public_relations security_studies sociology us_foreign_policy virology world_religions""".split()
)


def reading_comprehension(df: DataFrame, index_col: str | None = None) -> DataFrame:
    """(context, question, answers STRUCT<text ARRAY>): the first answer, '' if there is none; the context goes before the question."""
    shaped = df.withColumn("input", F.concat(F.lit("Context: "), F.coalesce("context", F.lit("")), F.lit("\nQuestion: "), F.col("question"))).withColumn(
        "expected", F.coalesce(F.get(F.col("answers.text"), 0), F.lit(""))
    )
    return canonical(shaped.drop("answers"), index_col=index_col, prefix="reading")


def language_understanding(df: DataFrame, task: str, index_col: str | None = None) -> DataFrame:
    if task not in GLUE_INPUT:
        raise ValueError(f"unknown task {task!r}; known: {', '.join(GLUE_INPUT)}")
    return canonical(df, GLUE_INPUT[task], "label", index_col=index_col, prefix=task)


def sentence_completion(df: DataFrame, index_col: str | None = None) -> DataFrame:
    """(ctx, endings ARRAY, label): the numbered endings go after the context."""
    listed = F.array_join(F.transform("endings", lambda e, i: F.concat(i.cast("string"), F.lit(". "), e)), "\n")
    shaped = df.withColumn("input", F.concat(F.col("ctx"), F.lit("\nChoices:\n"), listed)).withColumn("expected", F.col("label").cast("string"))
    return canonical(shaped, index_col=index_col, prefix="completion")


def truthfulness(df: DataFrame, index_col: str | None = None) -> DataFrame:
    return canonical(df, "question", "best_answer", index_col=index_col, prefix="truthful")
