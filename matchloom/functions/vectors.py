"""Vector functions on array columns; factors are widened to double before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import is_finite

SLACK = 1e-5


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def all_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & is_finite(x.cast("double")))


def is_unit(a: Column, tolerance: float = SLACK) -> Column:
    return F.abs(norm(a) - 1) <= tolerance


def clip(score: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))


def out_of_bounds(score: Column) -> Column:
    """Not a cosine, even with the slack that rounding needs; checked before clipping."""
    return score.isNull() | ~is_finite(score) | (F.abs(score) > 1 + SLACK)
