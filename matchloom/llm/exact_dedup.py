"""Exact deduplication by skew-safe combining.

Texts are equal when they agree after deleting every character of [\\x20\\x09-\\x0D].
The work goes in three combining stages, and each of them groups by the whole normalised
text beside its digest, so that two texts are never merged on the digest alone:

1. local: Spark's map-side aggregation merges the copies that one task reads;
2. salted: copies of a hot text meet in SALTS groups (digest, text, salt), so that a text that
   makes up a third of the corpus is spread over that many tasks; other texts need one group;
3. global: the at most SALTS salt winners of a hot text are combined.

A text is hot if it has over HOT of all rows. So at most 1 / HOT texts are hot, which bounds the table of
their digests that is broadcast. A row's salt is its number and hangs on no column, so rows without
doc_id, or with one and the same, are spread like others. Every distinct text of a task travels once.

What the decisions need of a row (doc_id, digest, length, row number) is checkpointed; the winners go
back to these rows by (digest, salt). Should two different texts ever share a SHA-256, the job stops with
an error instead of mixing them up.

Defined results: null text counts as empty; all empty and white texts are one group; very long texts
are compared whole; a null doc_id loses every tie against a number; of rows that repeat a doc_id in one
group, group_size counts each and only the longest (one of them, on a tie) is kept; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, checkpointed, id_and_text

SALTS = 64
#: The share of all rows from which on a text is hot, and the least number of rows of such a text.
HOT, LEAST_HOT = 0.001, 1000
#: A group's best row as one number: length * SPAN - doc_id; the largest wins.
SPAN, NO_ID = 2**65, 2**63


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def exact_duplicates(docs: DataFrame, salts: int = SALTS, least_hot: int = LEAST_HOT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    if not 1 <= salts <= 64:
        raise ValueError("salts must lie between 1 and 64")
    span, no_id = _number(SPAN), _number(NO_ID)
    whole = (
        id_and_text(docs)
        .withColumn("norm", F.regexp_replace("text", WHITESPACE + "+", ""))
        .select("doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("sha"), F.char_length("text").alias("chars"), F.monotonically_increasing_id().alias("row"))
    )
    rows = checkpointed(whole.drop("norm"))
    #: The first row of each group, by which one of several equal winners is told from the others.
    order = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    counted = checkpointed(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first")).select("sha", "rows", F.col("first.row").alias("first")))
    hot = counted.where(F.col("rows") > max(least_hot, int(HOT * rows.count()))).select("sha", F.lit(salts).alias("salts"))
    salted = lambda df: df.join(F.broadcast(hot), "sha", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod("row", "salts")).otherwise(F.lit(0)).cast("int"))
    score = (F.col("chars").cast("decimal(10,0)") * span - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), no_id)).cast("decimal(38,0)")
    texts = salted(whole.select("sha", "norm", "row", score.alias("score")))
    merged = texts.groupBy("sha", "norm", "salt", "salts").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    #: A text that isn't hot is whole by now: of its digest there must be one group. Only hot texts travel on.
    hot_text = F.when(F.col("salts").isNotNull(), F.col("norm"))
    combined = (
        merged.select("sha", hot_text.alias("norm"), "score", "n")
        .repartition("sha")
        .groupBy("sha", "norm")
        .agg(F.max("score").alias("score"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
        .groupBy("sha")
        .agg(F.max("score").alias("score"), F.max("n").alias("group_size"), F.sum(F.when(F.col("norm").isNull(), F.col("groups")).otherwise(1)).alias("contents"))
    )
    chars = F.expr(f"cast((score + cast('{NO_ID}' as decimal(20,0))) div cast('{SPAN}' as decimal(20,0)) as decimal(10,0))")
    keep = (chars * span - F.col("score")).cast("decimal(38,0)")
    winners = (
        combined.join(counted.select("sha", "first"), "sha")
        .join(F.broadcast(hot), "sha", "left")
        .select(
            F.when(F.col("contents") > 1, F.raise_error(F.lit("two different texts share one SHA-256"))).otherwise(F.col("sha")).alias("sha"),
            F.when(keep == no_id, F.lit(None)).otherwise(keep).cast("long").alias("keep_id"),
            "group_size",
            "first",
            F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"),
        )
    )
    return salted(rows).join(winners, ["sha", "salt"]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long"), (F.col("row") == F.col("first")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
