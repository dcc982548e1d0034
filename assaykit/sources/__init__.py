"""Reading samples, agent turns, traces and results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit import schemas
from assaykit.operators.agents import typed_turns

# Keys under which a JSON object may hold its list of samples.
LIST_KEYS = ("data", "samples", "examples", "items")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file: a list of objects, an object that holds such a list under one of LIST_KEYS, or one object."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema else reader).json(path)
    for key in LIST_KEYS:
        kind = df.schema[key].dataType if key in df.columns else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return df.select(F.inline(key))
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped, others that do not parse are an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted fields that may hold line breaks, and doubled quotes. Empty fields are null."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', mode="FAILFAST")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """A sheet, read on the driver; needs a pandas Excel engine."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


READERS: dict[str, Callable[..., DataFrame]] = {
    ".json": read_json, ".jsonl": read_jsonl, ".csv": read_csv, ".xlsx": read_excel, ".xls": read_excel,
    ".parquet": lambda spark, path, schema=None: spark.read.parquet(path), ".orc": lambda spark, path, schema=None: spark.read.orc(path),
}


def read_samples(spark: SparkSession, path: str, **kw) -> DataFrame:
    """A file or folder by its suffix; ValueError for an unknown suffix, FileNotFoundError for a missing local path."""
    suffix = Path(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"unknown format {suffix!r}; known: {', '.join(sorted(READERS))}")
    if "://" not in path and "*" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    return READERS[suffix](spark, path, **kw)


def from_samples(spark: SparkSession, rows: Iterable[dict] | Callable[[], Iterable[dict]], schema: str | None = None) -> DataFrame:
    """Rows held by the driver: a list, an iterable, or a function that returns one."""
    rows = list(rows() if callable(rows) else rows)
    return spark.createDataFrame(rows, schema or (None if rows else schemas.SAMPLE))


def read_agent_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Agent turns of CSV files, typed; columns maps fields to source columns."""
    return typed_turns(spark.read.options(header=True, multiLine=True, escape='"').csv(path), columns)


def read_agent_json(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Agent turns of a JSON array; elements that are no objects are skipped, nested values are read as their JSON text."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    if "_corrupt_record" in raw.columns:
        raw = raw.where("_corrupt_record is null").drop("_corrupt_record")
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in raw.schema.fields]
    return typed_turns(raw.select(*flat), columns)


def in_chunks(df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of `size`, a partition at a time on the driver."""
    chunk = []
    for row in df.toLocalIterator():
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def list_files(folder: str | None = None, files: list[str] | None = None, suffix: str = ".parquet") -> list[str]:
    """Files of a local folder, or those named: exactly one of both. A file of another suffix is an error."""
    if (folder is None) == (files is None):
        raise ValueError("give either a folder or files")
    found = sorted(str(p) for p in Path(folder).iterdir() if p.is_file() and not p.name.startswith((".", "_"))) if folder else list(files)
    wrong = [f for f in found if not f.endswith(suffix)]
    if wrong or not found:
        raise ValueError(f"files other than {suffix}: {wrong}" if wrong else "no files")
    return found


def read_trajectories(spark: SparkSession, folder: str | None = None, files: list[str] | None = None) -> DataFrame:
    """Agent trajectories; only the columns in use are read."""
    names = T.StructType.fromDDL(schemas.TRAJECTORY).names
    return spark.read.parquet(*list_files(folder, files)).select(*[F.col(c).cast("string") if c == "target" else F.col(c) for c in names])


def read_traces(spark: SparkSession, folder: str | None = None, files: list[str] | None = None) -> DataFrame:
    """Traces of JSON files, one object or a list each. A file that does not parse gives no rows."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schemas.TRACE + ", _bad STRING").json(list_files(folder, files, ".json"))
    return df.where("_bad is null and trace_id is not null").drop("_bad")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of an earlier run: CSV, a JSON array or JSON lines, told by the suffix and the first character."""
    if path.endswith(".csv"):
        return spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    first = spark.read.text(path, wholetext=False).where("trim(value) <> ''").first()
    return spark.read.option("multiLine", bool(first and first[0].lstrip().startswith("["))).json(path)


def read_runs(spark: SparkSession, pattern: str, ignore: Iterable[str] = ()) -> DataFrame:
    """CSV files of several runs with source_folder and thinking_mode (the file's name); ignored names are left out."""
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(pattern).select("*", F.col("_metadata.file_path").alias("_path"))
    parts = F.split("_path", "/")
    df = df.withColumn("thinking_mode", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")).withColumn("source_folder", F.try_element_at(parts, F.lit(-2)))
    return df.where(~F.col("thinking_mode").isin(*ignore)).drop("_path") if list(ignore) else df.drop("_path")


def union_sources(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Sources one below the other; a path that cannot be read is left out, none at all is an error."""
    frames = []
    for p in paths:
        try:
            frames.append(read_samples(spark, p))
        except (FileNotFoundError, ValueError):
            continue
    if not frames:
        raise FileNotFoundError("none of the sources can be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
