"""The corpus pipeline: stages that each read what the one before has kept.

Every stage's result is written as Parquet in the shared folder and read again, so a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import filters, packing, tokens
from matchloom.llm.common import read_table, work_dir
from matchloom.session import make_visible

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Chunks that a worker of the last stage remembers: a worker keeps them while it serves other stages.
CHUNKS = 100_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.without_toxic(docs, read_table(make_visible(spark), sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, ids, doc_tokens, sequence_id, offset."""
    make_visible(spark)
    return packing.pack_documents(docs, tokens.vocabulary("byte_bpe_50k.json"), end_id=0, memory=CHUNKS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The stages score, hash and encode in ways that SQL has no words for; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read_table(make_visible(spark), sf_dir, "documents")
    folder = work_dir(spark, "corpus")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
