"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one of them is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def mean_pool(vectors: Column, size: int) -> Column:
    """Mean of an array of vectors."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.element_at(v, i)) / F.size(vectors))
