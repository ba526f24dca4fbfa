"""Token counts through a cache keyed by digests.

The cache is a Parquet folder of (version, content, n_tokens). version is the SHA-256 of the library's name and
version, the vocabulary file and the rule of normalisation; content is the SHA-256 of the normalised text. Texts are
joined with the stored counts of their version; of those that miss, each distinct one is encoded once, and the
counts are appended to the cache, from which the result is then read.

Normalisation never changes a count: for vocabularies that drop white space, runs of `[\\x20\\x09-\\x0D]` become one
space and those at either end go; other vocabularies get the text as it is. The number of bytes is the whole text's.

Scale: one shuffle of the distinct missing texts, copies being merged before it; all else moves digests alone. A digest
in a third of the rows meets one cache row, and adaptive execution splits such a partition. Appending is one
atomic write; runs at the same time may store a count twice, which changes nothing.

Defined results: null and empty texts have no bytes and no tokens; very long texts go whole; repeated rows have a
row each; an empty table gives none; rows without doc_id are counted too; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from importlib.metadata import version as installed

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import WHITESPACE, checked_folder, checkpointed, id_and_text, work_dir

LIMIT = 2048
BATCH_CHARS = 1 << 20
STORED = "version string, content binary, n_tokens long"


def library(vocabulary: str) -> str:
    return "sentencepiece" if vocabulary.endswith(".model") else "tokenizers"


def drops_blanks(vocabulary: str) -> bool:
    return library(vocabulary) == "tokenizers" and not tokens.encoder(vocabulary).keeps_blanks


def version_digest(vocabulary: str) -> str:
    name = library(vocabulary)
    digest = hashlib.sha256(f"{name} {installed(name)} {'squeezed' if drops_blanks(vocabulary) else 'verbatim'}\n".encode())
    with open(vocabulary, "rb") as file:
        while part := file.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def normalised(text: Column, vocabulary: str) -> Column:
    return F.trim(F.regexp_replace(text, f"{WHITESPACE}+", " ")) if drops_blanks(vocabulary) else text


_COUNTERS: dict[str, Callable[[Sequence[str]], list[int]]] = {}


def counter(vocabulary: str) -> Callable[[Sequence[str]], list[int]]:
    """Counts of texts, without special tokens being added; one counter a worker process and vocabulary."""
    if vocabulary not in _COUNTERS:
        if library(vocabulary) == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            _COUNTERS[vocabulary] = lambda texts: [len(ids) for ids in model.encode(list(texts), num_threads=1)]
        else:
            encode = tokens.encoder(vocabulary).encode
            _COUNTERS[vocabulary] = lambda texts: [len(ids) // 4 for ids in encode(texts)]
    return _COUNTERS[vocabulary]


class CountCache:
    """Stored counts of one tokenizer's version in a folder that may hold those of many."""

    def __init__(self, spark: SparkSession, folder: str, vocabulary: str):
        self.spark, self.folder, self.vocabulary = spark, checked_folder(spark, folder), vocabulary
        self.version = version_digest(vocabulary)
        self._append(spark.range(0).select(F.lit(b"").alias("content"), F.lit(0).cast("long").alias("n_tokens")))

    def _append(self, counts: DataFrame) -> None:
        counts.select(F.lit(self.version).alias("version"), "content", "n_tokens").write.mode("append").parquet(self.folder)

    def stored(self) -> DataFrame:
        """content and n_tokens, a row each."""
        rows = self.spark.read.schema(STORED).parquet(self.folder).where(F.col("version") == self.version)
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def learn(self, texts: DataFrame) -> None:
        """Count the distinct texts (content, text) that are not stored yet and append them."""
        vocabulary = self.vocabulary

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counted = counter(vocabulary)
            for batch in batches:
                lengths = batch.column(2).to_pylist()
                for a, b in tokens.slices(batch.num_rows, lengths, BATCH_CHARS):
                    rows = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counted(rows.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])

        missing = texts.join(self.stored(), "content", "left_anti").dropDuplicates(["content"])
        self._append(missing.select("content", "text", F.char_length("text").alias("chars")).mapInArrow(count, "content binary, n_tokens long"))


def count_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; folder is the cache's, a new one in the shared folder if none is given.

    vocabulary is a file that every executor can read: .json of tokenizers or .model of sentencepiece.
    """
    spark = docs.sparkSession
    cache = CountCache(spark, folder or work_dir(spark, "token-counts"), vocabulary)
    texts = id_and_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("text", normalised(F.col("text"), vocabulary))
    texts = texts.withColumn("content", F.unhex(F.sha2("text", 256)))
    cache.learn(texts.select("content", "text"))
    # Written first, so that the join reads two plain shuffles, of which adaptive execution can split a hot one.
    counted = texts.select("doc_id", "n_bytes", "content").join(checkpointed(cache.stored()), "content")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
