"""Vector algebra over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def at(a: Column, k: int) -> Column:
    return F.coalesce(F.get(a, F.lit(k)), F.lit(0.0))


def cross(a: Column, b: Column) -> Column:
    """In three dimensions; shorter vectors are filled with zeros."""
    return F.array(at(a, 1) * at(b, 2) - at(a, 2) * at(b, 1), at(a, 2) * at(b, 0) - at(a, 0) * at(b, 2), at(a, 0) * at(b, 1) - at(a, 1) * at(b, 0))


def mean(points: Column) -> Column:
    """Centroid of an array of points."""
    n = F.size(points)
    first = F.transform(F.get(points, F.lit(0)), lambda _: F.lit(0.0))
    return F.aggregate(points, first, lambda s, p: add(s, p), lambda s: F.transform(s, lambda x: x / n))
