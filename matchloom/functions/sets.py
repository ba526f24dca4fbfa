"""Measures on sets of words, as array columns without repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _size(a: Column) -> Column:
    return F.size(a).cast("double")


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def novelty(a: Column, covered: Column) -> Column:
    """Share of a that isn't covered."""
    return _size(F.array_except(a, covered)) / F.greatest(F.lit(1.0), _size(a))


def jaccard(a: Column, b: Column) -> Column:
    return common(a, b) / F.greatest(F.lit(1.0), _size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Common words over the smaller set's size; null if one is empty."""
    least = F.least(_size(a), _size(b))
    return F.when(least > 0, common(a, b) / least)


def within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def near_duplicate(a: Column, b: Column) -> Column:
    """Jaccard of 0.65 or more, or an overlap of 0.85 or more of two sets with six and more words."""
    return (jaccard(a, b) >= 0.65) | ((F.size(a) >= 6) & (F.size(b) >= 6) & (F.coalesce(overlap(a, b), F.lit(0.0)) >= 0.85))
