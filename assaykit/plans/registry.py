"""Registering a query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """queries: name -> function(spark, folder); sql: name -> text for the queries that SQL can express."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to six decimals: both engines sum in orders of their own."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """df with every double rounded."""
    return df.select(*[F.round(F.col(f"`{n}`"), 6).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])
