"""Expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, empty, of another length, or zero."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), dot(a, b) / lengths)


def similarity(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1; null vectors give 0.0."""
    return F.coalesce((cosine(a, b) + 1) / 2, F.lit(0.0))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)
