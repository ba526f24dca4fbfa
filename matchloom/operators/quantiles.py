"""Exact quantiles of groups of any size, by selection instead of sorting.

A sketch a group brackets each wanted rank between two values. One more pass counts, a group, the rows of each value
inside a bracket and all rows of each stretch outside together, both combined before the shuffle. Running
sums over these counts (ranges.running) find the value at the rank. Were a bracket to miss its rank, the rank would
fall into a stretch; such groups are counted again with all their values.

A group's values never meet in one task, and of a group of n distinct values about 4 n / ACCURACY a wanted
fraction are shuffled. Nulls and NaN are left out; a group without values has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .ranges import running

#: A sketch's error is n / ACCURACY ranks; brackets reach twice as far on either side.
ACCURACY = 1000


def _equal(a: list[str], right: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(right[f"__{i}"]) for i, c in enumerate(a)])


def _joined(rows: DataFrame, facts: DataFrame, groups: list[str]) -> DataFrame:
    """rows with their group's facts; null groups meet too."""
    renamed = reduce(lambda d, x: d.withColumnRenamed(x[1], f"__{x[0]}"), enumerate(groups), facts)
    return rows.join(renamed, _equal(groups, renamed)).drop(*[f"__{i}" for i in range(len(groups))])


def _ranks(fractions: list[float], n: Column) -> list[tuple[Column, Column, Column]]:
    """Rank below, rank above (from 1) and the share of the one above, of each fraction of n rows."""
    places = [F.lit(float(p)) * (n - 1) for p in fractions]
    return [(F.floor(x) + 1, F.ceil(x) + 1, x - F.floor(x)) for x in places]


def quantiles_of_counts(cells: DataFrame, groups: list[str], fractions: list[float]) -> DataFrame:
    """groups and q, the quantiles (interpolated) of cells: groups, at, gap, n rows. q is null where a rank falls into a gap."""
    sums = running(cells, groups, ["at", "gap"], F.col("n"), "upto")
    total = cells.groupBy(*groups).agg(F.sum("n").alias("total"))
    ranks = _ranks(fractions, F.col("total"))
    wanted = [k for low, high, _ in ranks for k in (low, high)]
    holds = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
    found = _joined(sums, total, groups).where(reduce(Column.__or__, map(holds, wanted)))
    picked = [F.max(F.when(holds(k) & ~F.col("gap"), F.col("at"))).alias(f"v{i}") for i, k in enumerate(wanted)]
    both = found.groupBy(*groups, "total").agg(*picked)
    mix = [F.when(share == 0, F.col(f"v{2 * i}")).otherwise((1 - share) * F.col(f"v{2 * i}") + share * F.col(f"v{2 * i + 1}")) for i, (_, _, share) in enumerate(ranks)]
    missed = reduce(Column.__or__, [F.col(f"v{i}").isNull() for i in range(len(wanted))])
    return both.select(*groups, F.when(~missed, F.array(*mix)).alias("q"))


def _cells(values: DataFrame, groups: list[str], brackets: DataFrame | None) -> DataFrame:
    """Rows a value inside a bracket; rows outside count for the nearest bracket's end below them, as gaps behind it."""
    if brackets is None:
        placed = values.select(*groups, F.col("__v").alias("at"), F.lit(False).alias("gap"))
    else:
        inside = F.exists("lows", lambda b: (F.col("__v") >= b["low"]) & (F.col("__v") <= b["high"]))
        below = F.array_max(F.transform(F.filter("lows", lambda b: b["high"] < F.col("__v")), lambda b: b["high"]))
        placed = _joined(values, brackets, groups).select(*groups, F.when(inside, F.col("__v")).otherwise(below).alias("at"), (~inside).alias("gap"))
    return placed.groupBy(*groups, "at", "gap").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(rows: DataFrame, groups: list[str], value: str, fractions: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """groups and q, an array of the exact quantiles of value at the fractions, interpolated between neighbours."""
    values = rows.select(*groups, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    reach = 2 / accuracy
    edges = [(p - reach, p + reach) for p in fractions]
    asked = sorted({x for pair in edges for x in pair if 0 < x < 1})
    sketch = values.groupBy(*groups).agg(
        F.min("__v").alias("least"), F.max("__v").alias("most"),
        (F.percentile_approx("__v", asked, accuracy) if asked else F.array().cast("array<double>")).alias("s"),
    )
    at = lambda x: F.col("least") if x <= 0 else F.col("most") if x >= 1 else F.col("s")[asked.index(x)]
    brackets = sketch.select(*groups, F.array(*[F.struct(at(a).alias("low"), at(b).alias("high")) for a, b in edges]).alias("lows"))
    found = checkpointed(quantiles_of_counts(_cells(values, groups, brackets), groups, fractions))
    missed = found.where("q is null").drop("q")
    if missed.limit(1).count():
        again = quantiles_of_counts(_cells(_joined(values, missed.select(*groups, F.lit(1).alias("__missed")), groups).drop("__missed"), groups, None), groups, fractions)
        found = found.where("q is not null").unionByName(again)
    return found
