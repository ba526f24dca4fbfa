"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed as checkpointed
from ..session import shared_dir
from ..sources.stores import checked_folder as checked_folder
from ..sources.stores import filesystem as filesystem

WHITESPACE = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that extra columns can't clash; null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id, text and digest, the MD5 of the text: together they tell rows apart that repeat a doc_id or have none."""
    return id_and_text(docs).withColumn("digest", F.unhex(F.md5("text")))


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(items: Column, state: Column, move, emit, kind: str, block: int = 256) -> Column:
    """What emit(state, item), of type kind, gives for the items in turn, without nulls; state goes on by move(state, item).

    The results are gathered in blocks, so that a growing array is copied once a block and not once an item.
    """
    none = F.array().cast(f"array<{kind}>")
    shape = lambda s, got: F.struct(s.alias("state"), got.alias("got"))
    step = lambda s, x: shape(move(s["state"], x), F.concat(s["got"], F.array(emit(s["state"], x))))
    starts = lambda p: F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p), F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = bound(items, lambda p: F.transform(starts(p), lambda k: F.slice(p, k, F.lit(block))))
    part = lambda s, b: F.aggregate(b, shape(s["state"], none), step, lambda r: shape(r["state"], F.concat(s["got"], F.array(r["got"]))))
    return F.aggregate(blocks, shape(state, F.array().cast(f"array<array<{kind}>>")), part, lambda s: F.filter(F.flatten(s["got"]), lambda x: x.isNotNull()))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (start, rank, end, kind)."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
