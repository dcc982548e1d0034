"""The batch operators over streams: chunks are micro-batches, results do not depend on how they are cut."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators.aggregates import FUNCTIONS, known


def stream_files(spark: SparkSession, folder: str, fmt: str, schema: str, files_per_batch: int = 10, **options: str) -> DataFrame:
    """Files of a folder as a stream, so many a batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).load(folder)


def stream_aggregate(stream: DataFrame, key: str, scores: Sequence[str], functions: Sequence[str] = ("mean", "min", "max", "count")) -> DataFrame:
    """Running aggregates by key for outputMode complete or update; the state is one row per key. A median needs all
    values of a key, so it is an error here."""
    if "median" in functions:
        raise ValueError("a stream has no running median")
    aggs = [F.coalesce(FUNCTIONS[f](known(F.col(s))), F.lit(0.0)).alias(f"{f}_{s}") for f in functions for s in scores]
    return stream.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def flush(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Append each micro-batch to a table; a batch that is repeated after a failure replaces itself, as it is written under its number."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_requests(stream: DataFrame, ts: str = "ts", by: str = "event_type", width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, by, n, avg_value, max_value) per tumbling or sliding window; rows later than the watermark are left out."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = stream.withWatermark(ts, late).groupBy(window, by)
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "n", "avg_value", "max_value")


def request_sessions(stream: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, session_start, session_end, n): sessions end after a gap without requests."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
