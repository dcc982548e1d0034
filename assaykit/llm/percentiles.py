"""Percentiles of very large numeric columns by radix selection.

Values become integers of the same order (the bits of the double, negative ones flipped). A first
histogram counts their leading HEAD_BITS; it is the mergeable summary: histograms of separate days,
files or partitions are added up. Selection then follows, digit by digit, only those buckets that hold a
target rank, so every pass shuffles counts, not values, and no group is gathered in one task.

Errors: the summary alone bounds a percentile by its bucket, whose width is at most 2**-12 of the value
(HEAD_BITS less sign and exponent). After all digits the result is the exact value of that rank.
The percentile q of n values is the one of rank max(1, ceil(q * n)).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.session import cut, small_side

HEAD_BITS = 24
#: Bits of each further digit; with HEAD_BITS they make 64.
DIGITS = (20, 20)
QUANTILES = (0.5, 0.9, 0.95, 0.99)


@F.pandas_udf(T.LongType())
def order_key(value: pd.Series) -> pd.Series:
    """An integer that orders as the double does; nulls and NaN give null, -0.0 counts as 0.0."""
    x = value.to_numpy(dtype="float64", na_value=np.nan) + 0.0
    bits = x.view(np.int64)
    keys = pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits), dtype="Int64")
    return keys.mask(np.isnan(x))


@F.pandas_udf(T.DoubleType())
def key_value(key: pd.Series) -> pd.Series:
    """The double of an order key."""
    missing = key.isna().to_numpy()
    bits = key.fillna(0).to_numpy(dtype="int64")
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64)).mask(missing)


def keyed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, key): order keys of the values that are numbers."""
    return df.select(*keys, order_key(F.col(value).cast("double")).alias("key")).where("key is not null")


def summarize(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The mergeable summary: (keys, bucket, n). An empty table gives an empty summary; keys may be null."""
    return keyed(df, keys, value).groupBy(*keys, F.shiftright("key", 64 - HEAD_BITS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of any parts, united, as one summary by `keys` (some or all of theirs)."""
    return summaries.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def _locate(counts: DataFrame, within: Sequence[str], digit: str, ranks: Column) -> DataFrame:
    """Rows of counts (within, digit, n) whose digit holds a rank, with rank made relative to the digit.

    ranks: an array of structs (q, rank). Windows are over the digits of one group, at most 2**HEAD_BITS rows.
    """
    before = F.sum("n").over(W.partitionBy(*within).orderBy(digit).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    held = F.filter("ranks", lambda r: (r["rank"] > F.col("before")) & (r["rank"] <= F.col("before") + F.col("n")))
    return (
        counts.withColumn("ranks", ranks)
        .withColumn("before", before)
        .withColumn("ranks", held)
        .where("size(ranks) > 0")
        .withColumn("ranks", F.transform("ranks", lambda r: F.struct(r["q"].alias("q"), (r["rank"] - F.col("before")).alias("rank"))))
    )


def _targets(summary: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    group = W.partitionBy(*keys)
    total = summary.withColumn("total", F.sum("n").over(group))
    rank = [F.struct(F.lit(q).alias("q"), F.greatest(F.lit(1), F.ceil(F.round(F.lit(q) * F.col("total"), 6))).cast("long").alias("rank")) for q in quantiles]
    return _locate(total, keys, "bucket", F.array(*rank))


def bounds(summary: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(keys, n, q, low, high): what the summary alone tells; the percentile lies between low and high."""
    low, rest = F.shiftleft("bucket", 64 - HEAD_BITS), (1 << (64 - HEAD_BITS)) - 1
    found = _targets(summary, keys, quantiles).select(*keys, F.col("total").alias("n"), F.explode("ranks.q").alias("q"), low.alias("a"), (low + F.lit(rest)).alias("b"))
    return found.select(*keys, "n", "q", key_value("a").alias("low"), key_value("b").alias("high"))


def select(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES, summary: DataFrame | None = None) -> DataFrame:
    """(keys, n, q, value): exact percentiles. summary: that of df by keys, if there is one already.

    One pass over the columns for the summary and one per digit; each later pass keeps only rows whose
    leading bits are those of a target. The targets are as many as groups times quantiles; they are
    broadcast only if they were counted to be few.
    """
    source = keyed(df, keys, value)
    prefix, bits = "bucket", 64 - HEAD_BITS
    targets = cut(_targets(summarize(df, keys, value) if summary is None else summary, keys, quantiles).select(*keys, "bucket", "total", "ranks"))
    for width in DIGITS:
        bits -= width
        t = small_side(targets.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(prefix).alias("_prefix"), "total", "ranks"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.shiftright("key", bits + width) == F.col("_prefix")]
        condition = same[0]
        for c in same[1:]:
            condition &= c
        # Few distinct (group, prefix, digit) remain, and counting starts where the rows are read.
        counts = source.join(t, condition).groupBy(*keys, "_prefix", "total", "ranks", F.shiftright("key", bits).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        targets = cut(_locate(counts, [*keys, "_prefix"], "digit", F.col("ranks")).select(*keys, F.col("digit").alias("bucket"), "total", "ranks"))
    return targets.select(*keys, F.col("total").alias("n"), F.explode("ranks.q").alias("q"), key_value("bucket").alias("value"))


def spelled_alike(c: Column) -> Column:
    """A key without differences of case, blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "-")


def duration_percentiles(traces: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(project, environment, day, n, q, low, high, value) of duration_ms.

    A row per day of ingestion, bounded by its summary, and one with a null day for all days together, made
    by merging the daily summaries and refined to the exact value. Null projects and environments are
    groups of their own; other spellings of a key are one group.
    """
    rows = traces.select(
        spelled_alike(F.col("project")).alias("project"), spelled_alike(F.col("environment")).alias("environment"),
        F.to_date("ingested_at").alias("day"), F.col("duration_ms").cast("double").alias("v"),
    )
    daily = cut(summarize(rows, ["project", "environment", "day"], "v"))
    both = cut(merge(daily, ["project", "environment"]))
    exact = select(rows, ["project", "environment"], "v", quantiles, both)
    bounded = bounds(both, ["project", "environment"], quantiles).alias("b")
    same = F.expr("b.project <=> e.project and b.environment <=> e.environment and b.q = e.q")
    whole = bounded.join(exact.alias("e"), same).select(
        "b.project", "b.environment", F.lit(None).cast("date").alias("day"), "b.n", "b.q", "b.low", "b.high", "e.value"
    )
    by_day = bounds(daily, ["project", "environment", "day"], quantiles).withColumn("value", F.lit(None).cast("double"))
    return by_day.unionByName(whole)
