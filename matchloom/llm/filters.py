"""Filters over whole document tables, built from the operators' decisions.

Each takes a table with doc_id and text and returns rows of it with all its columns. Decisions are
small rows; they are broadcast only up to SMALL of them, else Spark joins by shuffle.

Rows are told apart by doc_id and a digest of their text, so that rows that repeat a doc_id, and rows
without one, are each judged by their own text. Rows that agree in both are copies: the filters of
duplicates keep one of them (which of them, where only other columns differ, is open), the others
keep or drop them all. Null and empty texts are texts like others. Empty tables give empty tables.
Columns that a filter adds on the way get a prefix that no column of the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, simhash_dedup, toxicity
from .common import WHITESPACE, checkpointed

SMALL = 200_000


def _free_prefix(docs: DataFrame) -> str:
    prefix = "__ml_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _without(docs: DataFrame, digest: Column, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone (doc_id, digest) names."""
    p = _free_prefix(docs)
    gone = checkpointed(gone.select(F.col("doc_id").alias(f"{p}id"), F.col("digest").alias(f"{p}digest")))
    if gone.limit(SMALL + 1).count() <= SMALL:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id")) & (digest == F.col(f"{p}digest")), "left_anti")


def _one_of_each(docs: DataFrame, digest: Column, verdict: DataFrame, order: Column) -> DataFrame:
    """The rows that verdict (doc_id, digest, stays, n) lets stay; where n > 1 rows agree, one with the largest order."""
    verdict = checkpointed(verdict.where("not stays or n > 1"))
    kept = _without(docs, digest, verdict.select("doc_id", "digest"))
    p = _free_prefix(docs)
    twice = verdict.where("stays").select(F.col("doc_id").alias(f"{p}id"), F.col("digest").alias(f"{p}digest"))
    if twice.isEmpty():
        return kept
    again = docs.join(twice, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id")) & (digest == F.col(f"{p}digest")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = again.groupBy(f"{p}id", f"{p}digest").agg(F.max_by(row, order).alias(f"{p}row")).select(f"{p}row.*")
    return kept.unionByName(one)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose toxicity score is under 0.5; no shuffle of texts."""
    machine = toxicity.fit(docs, labels)
    name = f"{_free_prefix(docs)}score"
    return docs.withColumn(name, toxicity.score_column(docs, machine, F.col("text"))).where(F.col(name) < 0.5).drop(name)


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The kept row of each group of equal texts: the longest, then the one with the smallest doc_id, a null one last."""
    judged = exact_dedup.exact_duplicates(docs)
    verdict = judged.groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    sha = F.unhex(F.sha2(F.regexp_replace(_text(), WHITESPACE + "+", ""), 256))
    return _one_of_each(docs, sha, verdict, F.char_length(_text()))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each class of near-duplicates, a null one last."""
    return _one_of_each(docs, F.unhex(F.md5(_text())), simhash_dedup.judged_rows(docs), F.lit(0))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that hold no benchmark item."""
    found = decontamination.contaminated_rows(docs, benchmark).select("doc_id", "digest").distinct()
    return _without(docs, F.unhex(F.md5(_text())), found)
