"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (both == 0), 0.0).otherwise(dot(a, b) / both)


def unit(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def blend(weighted: list[tuple[Column, float]]) -> Column:
    """Unit vector of a weighted sum."""

    def times(w: float):
        return lambda x: x * w

    total = None
    for v, w in weighted:
        part = F.transform(v.cast("array<double>"), times(w))
        total = part if total is None else F.zip_with(total, part, lambda x, y: x + y)
    n = norm(total) + 1e-9
    return F.transform(total, lambda x: x / n)
