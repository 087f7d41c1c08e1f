"""Vector arithmetic over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """Euclidean length, with 1 for a zero vector."""
    length = F.sqrt(dot(a, a))
    return F.when(length == 0, F.lit(1.0)).otherwise(length)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a side is empty or the lengths differ."""
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))
