"""Data-quality rules.

A rule is a table (rule, key, detail) of what breaks it; ``require`` raises on the driver with the
first rows. Rules are put together with ``violations``, so one action checks them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import SLACK, all_finite, norm, out_of_bounds

SHOWN = 20
#: Buckets of rows whose digests are compared: the driver gets one number of each that differs.
BUCKETS = 1024


class QualityError(ValueError):
    pass


def _broken(rows: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def violations(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def require(broken: DataFrame) -> None:
    rows = broken.limit(SHOWN).collect()
    if rows:
        raise QualityError("; ".join(f"{r.rule}: {r.key} {r.detail or ''}".strip() for r in rows))


def require_columns(rows: DataFrame, names, where: str = "input") -> None:
    missing = set(names) - set(rows.columns)
    if missing:
        raise QualityError(f"{where}: missing columns {sorted(missing)}")


def require_positive(**values: int) -> None:
    bad = [n for n, v in values.items() if v < 1]
    if bad:
        raise QualityError(f"{', '.join(bad)} must be positive")


def nonempty(rows: DataFrame, what: str) -> DataFrame:
    counted = rows.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return _broken(counted, f"{what} found: none", F.lit(what), F.col("n"))


def no_blank(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    blank = F.concat_ws(",", *[F.when(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) == "", F.lit(c)) for c in columns])
    return _broken(rows.withColumn("__blank", blank).where("__blank <> ''"), "values must be nonempty", F.col(f"`{key}`"), F.col("__blank"))


def unique_key(rows: DataFrame, key: str, label: str = "key") -> DataFrame:
    repeated = rows.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _broken(repeated, f"duplicate {label}", F.col("k"), F.col("n"))


def row_count(rows: DataFrame, expected: int, label: str) -> DataFrame:
    counted = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return _broken(counted, f"expected {expected} {label}", F.lit(label), F.col("n"))


def vectors(rows: DataFrame, key: str, width: int, tolerance: float = SLACK) -> DataFrame:
    """Width, finite numbers and unit length of each vector, the first rule that it breaks."""
    e = F.col("embedding")
    rule = (
        F.when(e.isNull() | (F.size(e) != width), F.lit(f"a vector of another width than {width}"))
        .when(~all_finite(e), F.lit("a vector with a number that is not finite"))
        .when(F.abs(norm(e) - 1) > tolerance, F.lit("a vector whose length is not one"))
    )
    broken = rows.select(F.col(f"`{key}`").cast("string").alias("key"), rule.alias("rule"), F.size(e).cast("string").alias("detail"))
    return broken.where("rule is not null").select("rule", "key", "detail")


def same_order(left: DataFrame, right: DataFrame, columns: list[str], pos: str = "pos") -> DataFrame:
    """Positions at which two tables differ, or that only one has."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(pos).alias("p"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name))

    joined = side(left, "l").join(side(right, "r"), "p", "full_outer")
    return _broken(joined.where(~F.col("l").eqNullSafe(F.col("r"))), "order or content differs", F.col("p"), F.to_json(F.struct("l", "r")))


def same_run(left: DataFrame, right: DataFrame, columns=("model", "revision")) -> DataFrame:
    """Two one-row statistics tables name the same model; null or blank counts as different."""
    pair = left.select(*[F.col(c).alias(f"l_{c}") for c in columns]).crossJoin(right.select(*[F.col(c).alias(f"r_{c}") for c in columns]).limit(1))
    wrong = reduce(Column.__or__, [F.coalesce(F.trim(f"l_{c}"), F.lit("")).isin("") | ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in columns])
    return _broken(pair.where(wrong), "model or revision differs", F.lit(",".join(columns)), F.to_json(F.struct("*")))


def cosine_bounds(pairs: DataFrame, key: str = "user_id") -> DataFrame:
    return _broken(pairs.where(out_of_bounds(F.col("score"))), "invalid cosine similarity values", F.col(key), F.col("score"))


def match_checks(matches: DataFrame) -> DataFrame:
    """Per subject: number of rows, distinct codes, whether ranks run 1, 2, ... and whether scores never rise."""
    by_rank = Window.partitionBy("user_id").orderBy("rank")
    rises = F.coalesce(F.col("score") > F.lag("score").over(by_rank), F.lit(False))
    return (
        matches.withColumn("rises", rises)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("code").alias("codes"),
            (F.sort_array(F.collect_list("rank")) == F.sequence(F.lit(1), F.count(F.lit(1)).cast("int"))).alias("contiguous"),
            (~F.bool_or("rises")).alias("ordered"),
        )
    )


def valid_matches(matches: DataFrame, k: int) -> DataFrame:
    wrong = (F.col("n") != k) | (F.col("codes") != k) | ~F.col("contiguous") | ~F.col("ordered")
    return _broken(match_checks(matches).where(wrong), "invalid recommendations", F.col("user_id"), F.to_json(F.struct("n", "codes", "contiguous", "ordered")))


def token_recount(profiles: DataFrame, recounted: Column, key: str, budget: int, limit: int) -> DataFrame:
    """Stored token counts equal a recount and stay within the budget, which is under the model's limit."""
    wrong = (F.col("token_count") != recounted) | (F.col("token_count") > budget) | F.lit(budget >= limit)
    return _broken(profiles.where(wrong), "token count differs or exceeds the budget", F.col(f"`{key}`"), F.col("token_count"))


def _digests(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """bucket and a struct of its rows' number and the sum of their digests, which no order changes."""
    bucket, digest = _bucket(columns), F.xxhash64(F.lit("sum"), *map(_named, columns)).cast("decimal(20,0)")
    return rows.groupBy(bucket.alias("bucket")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("sum")).alias(name))


def _named(column: str) -> Column:
    return F.col(f"`{column}`")


def _bucket(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), *map(_named, columns)), F.lit(BUCKETS))


def round_trip(written: DataFrame, read: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, as often as it has them more.

    Both are first compared by digests of BUCKETS buckets of rows, which are combined before the shuffle; only rows
    of buckets that differ are then compared one by one. Two different buckets pass for equal if the sums of their 64-bit
    digests are.
    """
    columns = written.columns
    if sorted(columns) != sorted(read.columns):
        raise QualityError(f"round trip: columns {sorted(set(columns) ^ set(read.columns))} are on one side only")
    read = read.select(*map(_named, columns))
    sides = _digests(written, columns, "l").join(_digests(read, columns, "r"), "bucket", "full_outer")
    differ = [r.bucket for r in sides.where(~F.col("l").eqNullSafe(F.col("r"))).select("bucket").collect()]
    part = lambda df: df.where(_bucket(columns).isin(differ) if differ else F.lit(False))
    lost = part(written).exceptAll(part(read)).select(F.to_json(F.struct("*")).alias("row"), F.lit("lost").alias("how"))
    new = part(read).exceptAll(part(written)).select(F.to_json(F.struct("*")).alias("row"), F.lit("new").alias("how"))
    return _broken(lost.unionByName(new), "round trip failed", F.col("how"), F.col("row"))
