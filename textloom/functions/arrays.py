"""Statistics inside a row's array, so that a group needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_mean(values: Column) -> Column:
    """Mean; 0 for an empty array."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)


def array_quantile(ordered: Column, p: float) -> Column:
    """Linear quantile at (n - 1) * p of a sorted array; 0 for an empty one."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a = F.get(ordered, low)
    b = F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, a + (b - a) * (at - low)).otherwise(0.0)


def occurrences(text: Column, token: str) -> Column:
    """How often a token occurs, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / F.length(F.lit(token))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(size, F.lit(0.0))
