"""Run statistics and the documented analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BUDGET, MODEL_LIMIT, MODEL_NAME, MODEL_REVISION, TARGET
from ..session import checkpointed
from .quantiles import exact_quantiles, quantiles_of_counts

#: Bits of a mask that is never negative.
MOST_SOURCES = 62


def token_audit(rows: DataFrame, tokens: Column, limit: int = MODEL_LIMIT) -> DataFrame:
    """One row: number, mean, median, least and most tokens, those over the limit and in the target range."""
    cells = rows.groupBy(tokens.cast("double").alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("gap", F.lit(False))
    counts = checkpointed(cells)  # a row a number of tokens; the texts are read once
    median = quantiles_of_counts(counts.where("at is not null").withColumn("one", F.lit(1)), ["one"], [0.5]).select(F.col("q")[0].alias("median"))
    total, share = F.sum("n"), lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    facts = counts.agg(
        F.coalesce(total, F.lit(0)).alias("profiles"), (F.sum(F.col("at") * F.col("n")) / F.sum(F.when(F.col("at").isNotNull(), F.col("n")))).alias("average_tokens"),
        F.min("at").cast("int").alias("minimum_tokens"), F.max("at").cast("int").alias("maximum_tokens"),
        (100 * share(F.col("at") > limit) / total).alias("percentage_over_limit"), share(F.col("at").between(TARGET, BUDGET)).alias("profiles_in_245_to_250_range"),
    )
    return facts.join(median, F.lit(True), "left").select(
        "profiles", "average_tokens", F.col("median").alias("median_tokens"), "minimum_tokens", "maximum_tokens", "percentage_over_limit", "profiles_in_245_to_250_range"
    )


def run_stats(rows: DataFrame, tokens: Column, model: str = MODEL_NAME, revision: str = MODEL_REVISION, **more) -> DataFrame:
    """token_audit with the model's identity, the literal share of truncated texts and further facts."""
    return token_audit(rows, tokens).select(
        F.lit(model).alias("model"), F.lit(revision).alias("revision"), "*", F.lit(MODEL_LIMIT).alias("token_limit_including_special_tokens"),
        F.lit(0.0).alias("percentage_truncated"), *[F.lit(v).alias(k) for k, v in more.items()],
    )


def five_numbers(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges and outliers a group; highest median first."""
    quartiles = exact_quantiles(rows, [group], value, [0.25, 0.5, 0.75]).select(group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        rows.join(quartiles, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(value).alias("minimum"), F.max(value).alias("maximum"),
            F.min(F.when(inside, F.col(value))).alias("low_whisker"), F.max(F.when(inside, F.col(value))).alias("high_whisker"),
            F.count_if(~inside).alias("outliers"),
        )
        .orderBy(F.desc("median"), group)
    )


def coverage(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """source, covered, lacking, share: parents with and without a row in each child table.

    A source is a bit of a mask a key, so all of them meet in one shuffle, combined before it. Null keys are covered by none.
    """
    if len(children) > MOST_SOURCES:
        raise ValueError(f"at most {MOST_SOURCES} sources")
    marks = [rows.select(key, F.lit(0).alias("n"), F.lit(1 << i).cast("long").alias("mask")).where(F.col(key).isNotNull()) for i, rows in enumerate(children.values())]
    marked = reduce(DataFrame.unionByName, marks, parents.select(key, F.lit(1).alias("n"), F.lit(0).cast("long").alias("mask")))
    parent = marked.groupBy(key).agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask")).where("n > 0")
    has = lambda i: F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n"))), F.lit(0))
    counts = [F.struct(F.lit(n).alias("source"), has(i).alias("covered"), (F.coalesce(F.sum("n"), F.lit(0)) - has(i)).alias("lacking")) for i, n in enumerate(children)]
    found = parent.agg(F.array(*counts).alias("all")).select(F.inline("all"))
    return found.withColumn("share", F.try_divide("covered", F.col("covered") + F.col("lacking")))


def rank_summary(matches: DataFrame) -> DataFrame:
    """rank, matches, distinct codes, mean, least and largest score."""
    return matches.groupBy("rank").agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("code").alias("codes"), F.avg("score").alias("mean_score"),
        F.min("score").alias("least_score"), F.max("score").alias("largest_score"),
    )
