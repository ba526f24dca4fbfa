"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and the first 5 and 7 bytes of longer words, as 64-bit hashes;
a term counts once a text. The score is

    sigmoid(bias + sum of w[t] + sum over pairs of terms of <v[t], v[u]>)

so that pairs of terms, such as an insult and the group it is aimed at, have a weight of
their own. The pair sum costs one pass: half of (sum of v)^2 - sum of v^2.

Fitting: at most LABELLED labelled documents, those with the smallest hash of their doc_id, and only
such whose crc32(doc_id as text) mod 5 is not 0, each with one text, that of least digest where rows repeat its
doc_id. Their texts are read once and checkpointed. Counts of terms by label are a Spark aggregation
over these; every term in MIN_TEXTS texts or more whose log-likelihood ratio is SIGNIFICANT or more gets
weights, however many these are: no more than the bounded sample has terms. Their occurrences in the sample
go to the driver as sparse lists, which fits the machine by full-batch Adam. All documents are scored whole,
in a map without a shuffle. doc_id, lang, source and labels are no inputs of a score.

Defined results: null and empty texts get the bias alone; without any toxic or any other
labelled text, all scores are 0; very long texts are read whole; a document with several label rows counts as toxic if one
of them says so; null labels and labels without a document are left out; a null doc_id
isn't held out; repeated rows each get their row and are one document to the fit; an empty table gives none; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import checkpointed, id_and_text

FOLDS = 5
LABELLED, SIGNIFICANT, MIN_TEXTS = 12_000, 3.0, 3
PREFIXES = (5, 7)
FACTORS, STEPS, RATE, RIDGE, SEED = 4, 240, 0.05, 2e-3, 7
TABLE_BITS = 22


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, term) of all terms of a slice, repeats included."""
    words = wordhash.words_of(data, offsets)
    docs, hashes = [words.doc], [words.hash]
    for size in PREFIXES:
        at, h = words.prefixes(size)
        docs.append(words.doc[at])
        hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass
class FactorizationMachine:
    keys: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    constant: bool = False

    def __post_init__(self):
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def active(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc, index of key) of each active term of each text, once a text."""
        doc, h = terms(data, offsets)
        maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        doc, h = doc[maybe], h[maybe]
        at = np.searchsorted(self.keys, h)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == h) if len(self.keys) else np.zeros(0, np.int64)
        once = np.unique(doc[hit] * len(self.keys) + at[hit])
        size = max(len(self.keys), 1)
        return once // size, once % size

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.constant:
            return np.zeros(n)
        doc, k = self.active(data, offsets)
        z = self.bias + np.bincount(doc, self.weights[k], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[k, f]
            z += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train_machine(keys: np.ndarray, doc: np.ndarray, k: np.ndarray, y: np.ndarray, factors: int = FACTORS) -> FactorizationMachine:
    """Fit on occurrences (doc, index of key) and labels y by full-batch Adam with ridge penalties; work and memory go by the occurrences."""
    n, m = len(y), len(keys)
    summed = lambda at, x, size: np.stack([np.bincount(at, x[:, f], size) for f in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((size, 0))
    prior = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    params = [np.array([prior]), np.zeros(m), np.random.default_rng(SEED).normal(0, 0.01, (m, factors))]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, STEPS + 1):
        bias, w, v = params
        each = v[k]
        s = summed(doc, each, n)
        z = bias + np.bincount(doc, w[k], n) + 0.5 * ((s * s).sum(axis=1) - np.bincount(doc, (each * each).sum(axis=1), n))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        by_key = np.bincount(k, g[doc], m)
        grads = [np.array([g.sum()]), by_key + RIDGE * w / max(m, 1), summed(k, (g[:, None] * s)[doc], m) - v * by_key[:, None] + RIDGE * v / max(m, 1)]
        for i, grad in enumerate(grads):
            means[i] = 0.9 * means[i] + 0.1 * grad
            squares[i] = 0.999 * squares[i] + 0.001 * grad * grad
            params[i] = params[i] - RATE * (means[i] / (1 - 0.9**t)) / (np.sqrt(squares[i] / (1 - 0.999**t)) + 1e-8)
    return FactorizationMachine(keys, float(params[0][0]), params[1], params[2])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """Learn labels.toxic from a bounded sample of the labelled documents that aren't held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .where(~held_out(F.col("doc_id")))
    )
    texts = id_and_text(docs)
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    present = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = checkpointed(present.orderBy(*by_hash).limit(LABELLED))  # two numbers a row, which bounds what is broadcast
    # One text a document, the one of least digest, so that repeated rows neither weigh more nor fill the driver.
    one = F.min(F.struct(F.md5("text").alias("digest"), "text"))
    sample = checkpointed(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(one.alias("one")).select("one.text", "y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a, data, offsets in wordhash.text_slices(batch.column(0)):
                doc, h = terms(data, offsets)
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[new], h[new]
                starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
                toxic = np.add.reduceat(y[a + doc], starts) if len(h) else starts
                sizes = np.diff(np.concatenate((starts, [len(h)])))
                yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array(sizes.astype(np.int64))], names=["term", "toxic", "n"])

    sums = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    total, toxic = int(sums[0]), int(sums[1])
    if toxic in (0, total):
        return FactorizationMachine(np.zeros(0, np.uint64), 0.0, np.zeros(0), np.zeros((0, FACTORS)), constant=True)
    counted = sample.select("text", "y").mapInArrow(count, "term long, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    b, rate = n - a, toxic / total
    ratio = part(a, n * rate) + part(b, n * (1 - rate)) + part(toxic - a, (total - n) * rate + 1e-9) + part(total - toxic - b, (total - n) * (1 - rate) + 1e-9)
    chosen_terms = counted.where(ratio >= SIGNIFICANT).select("term").toArrow().column("term")
    keys = np.sort(chosen_terms.to_numpy().astype(np.int64).view(np.uint64))
    machine = FactorizationMachine(keys, 0.0, np.zeros(len(keys)), np.zeros((len(keys), FACTORS)))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(keys)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = FactorizationMachine(shared.value, 0.0, np.zeros(0), np.zeros((0, 0)))
        for batch in batches:
            y = batch.column(1).to_numpy()
            for start, data, offsets in wordhash.text_slices(batch.column(0)):
                doc, k = of.active(data, offsets)
                rows = len(offsets) - 1
                lists = np.split(k.astype(np.int32), np.searchsorted(doc, np.arange(1, rows)))
                yield pa.RecordBatch.from_arrays([pa.array(y[start : start + rows].astype(np.int32)), pa.array(lists, pa.list_(pa.int32()))], names=["y", "terms"])

    found = sample.select("text", "y").mapInArrow(occurrences, "y int, terms array<int>").toArrow()
    y = found.column("y").to_numpy().astype(np.float32)
    lists = found.column("terms").to_pylist()
    order = sorted(range(len(lists)), key=lambda i: (lists[i], y[i]))  # the sum's order doesn't hang on the partitions
    lists, y = [lists[i] for i in order], y[order]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    k = np.array([x for row in lists for x in row], dtype=np.int64)
    return train_machine(machine.keys, doc, k, y)


def score_column(docs: DataFrame, machine: FactorizationMachine, text: Column) -> Column:
    """The score of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.keys, machine.bias, machine.weights, machine.factors, machine.constant))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = FactorizationMachine(*shared.value)
        for batch in batches:
            parts = [of.scores(data, offsets) for _, data, offsets in wordhash.text_slices(pa.array(batch, pa.large_string()))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    machine = fit(docs, labels)
    rows = id_and_text(docs)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs, machine, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
