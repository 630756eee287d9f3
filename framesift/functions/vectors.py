"""Vectors as arrays of float; sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A norm below this counts as this, so that a zero vector stays zero.
LEAST_NORM = 1e-12


def truncate(vector: Column, dimension: int) -> Column:
    return F.slice(vector, 1, dimension)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalise(vector: Column) -> Column:
    """Unit length, as doubles."""
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm(vector), F.lit(LEAST_NORM)))


def prepare(vector: Column, dimension: int) -> Column:
    """First truncated, then of unit length."""
    return normalise(truncate(vector, dimension))
