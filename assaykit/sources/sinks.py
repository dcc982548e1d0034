"""Writing samples, results and reports."""

from __future__ import annotations

import html
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_for_csv(df: DataFrame) -> DataFrame:
    """df with lists, structs and maps as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", quote_all: bool = False) -> None:
    """CSV that the readers read back; empty text stays apart from null."""
    flat_for_csv(df).write.mode(mode).options(header=True, escape='"', quoteAll=quote_all, emptyValue='""').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str) -> int:
    """One local file with a JSON array of the rows; returns how many. A partition at a time passes through the driver."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            f.write((",\n" if n else "\n") + row["j"])
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n


def jsonl_to_array(spark: SparkSession, source: str, path: str) -> int:
    """A file of JSON lines as one JSON array, each object as it was written; blank lines are skipped, other text is an error."""
    lines = spark.read.text(source).where("trim(value) <> ''")
    if lines.where(F.try_parse_json("value").isNull()).limit(1).count():
        raise ValueError(f"{source} holds lines that are not JSON")
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in lines.toLocalIterator():
            f.write((",\n" if n else "\n") + row["value"].strip())
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n


def append_checked(df: DataFrame, path: str) -> None:
    """Append to a Parquet table of the same columns; others are an error."""
    spark = df.sparkSession
    if Path(path).exists() or "://" in path:
        have = spark.read.parquet(path).columns
        if have != df.columns:
            raise ValueError(f"columns differ: {have} and {df.columns}")
    df.write.mode("append").parquet(path)


def merge_results(samples: DataFrame, summary: DataFrame, path: str) -> None:
    """Results of a run beside those of earlier ones, by model: a model of this run replaces its earlier results, others stay.

    Both tables lie in a folder per model, and only those of this run's models are written.
    """
    for df, name in ((samples, "samples"), (summary, "summary")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(f"{path}/{name}")


def _first(rows: DataFrame, limit: int, failing: Column | None) -> tuple[list, int, int]:
    """The first rows up to the limit, those that fail before others; how many rows and failing rows there are in all."""
    bad = F.lit(False) if failing is None else failing
    counts = rows.select(bad.alias("f")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("f").cast("long")), F.lit(0)).alias("k")).first()
    ordered = rows if failing is None else rows.orderBy(F.desc(failing))
    return ordered.limit(limit).collect(), counts["n"], counts["k"]


def report_html(rows: DataFrame, title: str, limit: int = 1000, failing: Column | None = None) -> str:
    """A table of the first `limit` rows, for reports of aggregates. Rows that fail come first; how many are left out is said."""
    got, n, _ = _first(rows, limit, failing)
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in rows.columns)
    body = "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in got)
    left = f"<p>{n - len(got)} of {n} rows are left out.</p>" if n > len(got) else ""
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>{left}"


def report_markdown(rows: DataFrame, limit: int = 1000, failing: Column | None = None) -> str:
    got, n, _ = _first(rows, limit, failing)
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    left = ["", f"{n - len(got)} of {n} rows are left out."] if n > len(got) else []
    return "\n".join([line(rows.columns), "|" + "---|" * len(rows.columns), *map(line, got), *left])


def report_junit(rows: DataFrame, name: str, score: str, fail_below: float, suite: str = "evaluation", limit: int = 10_000) -> str:
    """JUnit XML with a case per row of a small result; scores below the limit fail. Tests and failures are those of all rows."""
    got, n, k = _first(rows.select(name, score), limit, F.coalesce(F.col(score), F.lit(0.0)) < fail_below)
    cases = "".join(
        f"<testcase name={quoteattr(str(r[0]))}>" + (f"<failure message={quoteattr(f'score {r[1]} is below {fail_below}')}/>" if (r[1] or 0.0) < fail_below else "") + "</testcase>" for r in got
    )
    left = f"<system-out>{n - len(got)} of {n} rows are left out.</system-out>" if n > len(got) else ""
    return f'<?xml version="1.0"?><testsuite name={quoteattr(suite)} tests="{n}" failures="{k}">{cases}{left}</testsuite>'
