"""Shaping, choosing and comparing samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.text import few_shot_header, multiple_choice_prompt


def canonical(df: DataFrame, input_col: str = "input", expected_col: str = "expected", id_col: str | None = None, index_col: str | None = None, prefix: str = "custom") -> DataFrame:
    """(id, input, expected, original_*): rows whose input and expected are not null, as strings; every other column is kept as original_<name>.

    Ids are those of id_col; missing ones are <prefix>_<index>, or a hash of the row where no index is given,
    which does not depend on how the data is split.
    """
    fallback = F.col(f"`{index_col}`").cast("string") if index_col else F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if df.schema[c].dataType.typeName() != "map"]))
    ids = F.concat(F.lit(f"{prefix}_"), fallback)
    if id_col:
        ids = F.coalesce(F.col(f"`{id_col}`").cast("string"), ids)
    rest = [F.col(f"`{c}`").alias(f"original_{c}") for c in df.columns if c not in (input_col, expected_col)]
    out = df.where(F.col(f"`{input_col}`").isNotNull() & F.col(f"`{expected_col}`").isNotNull())
    return out.select(ids.alias("id"), F.col(f"`{input_col}`").cast("string").alias("input"), F.col(f"`{expected_col}`").cast("string").alias("expected"), *rest)


def choice_samples(items: DataFrame, id_col: str = "item_id", subject: str = "subset", few_shot: int = 0) -> DataFrame:
    """(id, input, expected, question, choices, answer_index, subject) of multiple-choice items; answers out of range give a
    null expected. With few_shot the header of the subject's examples stands before the question."""
    prompt = multiple_choice_prompt(F.col("question"), F.col("choices"))
    if few_shot > 0:
        prompt = F.concat(few_shot_header(F.col(subject)), F.lit("\n\n"), prompt)
    return items.where("question is not null and choices is not null").select(
        F.col(id_col).cast("string").alias("id"), prompt.alias("input"), F.get("choices", "answer").alias("expected"),
        "question", "choices", F.col("answer").alias("answer_index"), F.col(subject).alias("subject"),
    )


def only_subjects(items: DataFrame, subjects: Sequence[str] | None, known: Sequence[str], subject: str = "subset") -> DataFrame:
    """Items of the subjects; None means all. A subject that is not known is an error."""
    unknown = sorted(set(subjects or ()) - set(known))
    if unknown:
        raise ValueError(f"unknown subjects: {', '.join(unknown)}")
    return items if subjects is None else items.where(F.col(subject).isin(list(subjects)))


def choose(df: DataFrame, n: int | None, seed: int = 42, id_col: str = "id") -> DataFrame:
    """n rows, the same ones for the same seed however the data is split; None takes all, 0 none. Ties by id."""
    if n is None:
        return df
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 100) -> DataFrame:
    """Rows offset .. offset + limit of an order, which must end in a unique key for pages not to overlap."""
    return df.orderBy(*order).offset(offset).limit(limit)


def search_traces(traces: DataFrame, start: str | None = None, end: str | None = None, project: str | None = None, environment: str | None = None, status: str | None = None, user: str | None = None, term: str | None = None) -> DataFrame:
    """Traces that meet every condition given; status and environment by any case, term in the name, user in a span's user.id."""
    if start:
        traces = traces.where(F.col("start_time") >= start)
    if end:
        traces = traces.where(F.col("start_time") < end)
    if project:
        traces = traces.where(F.col("project") == project)
    for name, value in (("environment", environment), ("status", status)):
        if value:
            traces = traces.where(F.lower(F.col(name)) == value.lower())
    if user:
        traces = traces.where(F.exists("spans", lambda s: F.try_element_at(s["attributes"], F.lit("user.id")) == user))
    return traces.where(F.lower("name").contains(term.lower())) if term else traces


def validate(df: DataFrame, required: Sequence[str] = ("input", "expected")) -> DataFrame:
    """df, if it has the required columns; else ValueError."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def join_predictions(samples: DataFrame, predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    return samples.join(predictions, key)


def for_models(samples: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every sample once per model; the models are a literal list, so nothing is joined."""
    return samples.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def union_all(frames: Sequence[DataFrame], fill: str | None = None) -> DataFrame:
    """Frames one below the other by column name; a column that a frame lacks is null, or `fill` in all columns as text."""
    if fill is not None:
        names = list(dict.fromkeys(c for f in frames for c in f.columns))
        frames = [f.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in f.columns else F.lit(fill).alias(c) for c in names]) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def version_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("item_key",)) -> DataFrame:
    """(keys, change): added, removed or changed; rows are compared by a hash of all other columns. Repeated keys compare as sets."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in sorted(df.columns) if c not in keys]
        return df.groupBy(*keys).agg(F.sort_array(F.collect_set(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in rest]))).alias(name))

    both = digest(old, "_a").join(digest(new, "_b"), list(keys), "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.withColumn("change", change).where("change is not null").drop("_a", "_b")


def without_result(items: DataFrame, results: DataFrame, key: str = "item_id") -> DataFrame:
    return items.join(results, key, "left_anti")


def preprocess(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def fill_model(runs: DataFrame, file_col: str = "source_file") -> DataFrame:
    """runs with missing `model` filled by the least one named in the same file."""
    named = runs.where("model is not null").groupBy(file_col).agg(F.min("model").alias("_m"))
    return runs.join(named, file_col, "left").withColumn("model", F.coalesce("model", "_m")).drop("_m")


def without_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the columns and, at any depth of structs, the fields of these names."""
    from pyspark.sql import types as T

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if f.name not in names]
            return F.when(c.isNotNull(), F.struct(*[clean(c.getField(f.name), f.dataType).alias(f.name) for f in kept])) if kept else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in names])


def search_items(items: DataFrame, version: str | None = None, item_type: str | None = None, term: str | None = None) -> DataFrame:
    """Items of a version (a.b.c, else ValueError), of a type, and with a term in their content, by any case."""
    if version is not None:
        if not re.fullmatch(r"\s*\d+\.\d+\.\d+\s*", version):
            raise ValueError(f"no version: {version!r}")
        items = items.where(F.col("version") == version.strip())
    if item_type:
        items = items.where(F.col("item_type") == item_type)
    return items.where(F.lower("content").contains(term.lower())) if term else items


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current with the rows of changes put in by key; a null in `_deleted` or false keeps, true removes. Of changes to one key the greatest counts."""
    flagged = changes if "_deleted" in changes.columns else changes.withColumn("_deleted", F.lit(False))
    rest = [c for c in current.columns if c not in keys]
    last = flagged.groupBy(*keys).agg(F.max(F.struct(*rest, F.coalesce("_deleted", F.lit(False)).alias("_deleted"))).alias("_v"))
    kept = current.join(last, list(keys), "left_anti").select(current.columns)
    return kept.unionByName(last.where("not _v._deleted").select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest]))


def with_scores(samples: DataFrame, scores: DataFrame, key: str = "sample_id", default: float = 0.0) -> DataFrame:
    """samples with the score of each, or the default; of several scores the greatest."""
    best = scores.groupBy(key).agg(F.max("score").alias("score"))
    return samples.join(best, key, "left").withColumn("score", F.coalesce("score", F.lit(default)))


def refreshed_means(summary: DataFrame, detail: DataFrame, by: str = "subset") -> DataFrame:
    """summary (by, mean) with means recomputed from detail (by, score); groups without detail keep theirs."""
    new = detail.groupBy(by).agg(F.avg("score").alias("_new"))
    return summary.join(new, by, "left").withColumn("mean", F.coalesce("_new", "mean")).drop("_new")
