"""Expressions on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null for different sizes or a zero vector."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def l2_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(gap)))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def subsample(a: Column, most: int) -> Column:
    """At most `most` values at equal steps; an empty array stays empty."""
    step = F.greatest(F.lit(1.0), F.size(a) / most)
    picked = F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.size(a), F.lit(most)) - 1, F.lit(0))), lambda i: F.get(a, F.floor(i * step).cast("int")))
    return F.when(F.size(a) > 0, picked).otherwise(F.slice(a, 1, 0))
