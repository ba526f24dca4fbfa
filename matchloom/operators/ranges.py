"""Running sums and numbers of rows inside groups of any size.

Rows are dealt by ranges of (group, order), so one group may fill many tasks. A range sums up its own rows;
what earlier ranges hold of its first group is carried over by a prefix sum with one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def _same(columns: list[str], other: str) -> Column:
    """Whether the columns equal the fields k0, k1, ... of another one, nulls being equal."""
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"{other}.k{i}")) for i, c in enumerate(columns)])


def running(rows: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """rows with `name`, the sum of amount over its group's rows up to it by order (nulls first).

    Rows alike in keys and order come in any order. Without keys, the whole table is one group. Columns that start with __range_ are taken.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    if not keys:
        rows, keys = rows.withColumn("__range_all", F.lit(0)), ["__range_all"]
    dealt = checkpointed(rows.withColumn("__range_amount", amount.cast("long")).repartitionByRange(*keys, *order).withColumn("__range_part", F.spark_partition_id()))
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)])
    pieces = dealt.groupBy("__range_part", *keys).agg(F.sum("__range_amount").alias("__range_n"))
    edges = pieces.groupBy("__range_part").agg(F.min(key).alias("__range_first"), F.max(key).alias("__range_last"), F.max_by("__range_n", key).alias("__range_tail"))
    in_turn = Window.orderBy("__range_part")  # a row a range
    run = F.sum("__range_tail").over(Window.partitionBy("__range_last").orderBy("__range_part"))
    carried = edges.withColumn("__range_run", run).select(
        F.col("__range_part").alias("__range_of"), "__range_first", F.when(F.lag("__range_last").over(in_turn).eqNullSafe(F.col("__range_first")), F.lag("__range_run").over(in_turn)).otherwise(0).alias("__range_before")
    )
    upto = Window.partitionBy("__range_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.withColumn("__range_inside", F.sum("__range_amount").over(upto)).join(F.broadcast(carried), F.col("__range_part") == F.col("__range_of"))
    return joined.select(*columns, (F.col("__range_inside") + F.when(_same(keys, "__range_first"), F.col("__range_before")).otherwise(0)).alias(name))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """rows with `name`, a row's number in its group from 1."""
    return running(rows, keys, order, F.lit(1), name)
