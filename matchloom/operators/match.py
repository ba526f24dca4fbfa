"""Exact top-k by cosine similarity of unit vectors.

Every subject is scored against every candidate, as there is no index in the design, and only
k rows a subject leave a task. Three plans give the same rows:

* ``topk_columns``: Catalyst expressions over a broadcast of the candidates; easy to read and to check;
* ``topk_arrow``: matrix products over Arrow batches, with the smaller side broadcast and the other in as many tasks as there are cores;
* ``topk_blocks``: both sides dealt into blocks, each pair of blocks a group of its own, for two
  large sides; a task holds two blocks.

A side is broadcast only if its vectors take at most SMALL_BYTES; ``topk`` picks a plan by that.
Scores are sums of float64 products in the order of the components, checked to be cosines and clipped; ties go by code.
Matrix products only find who may be among the best, with room for their rounding, so that copies tie wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import SLACK, clip, dot, out_of_bounds

SMALL_BYTES = 64 << 20
BLOCK_ROWS = 16_384
#: Subjects and candidates of one matrix product; more than rounding moves a score.
SUBJECTS, CANDIDATES, ROUNDING = 256, 4096, 1e-11
PAIRS = "user_id {user}, code {code}, score double"


def checked_k(k: int, candidates: int) -> None:
    if not 1 <= k <= candidates:
        raise ValueError("k must be between one and the number of candidates")


def measured(vectors: DataFrame) -> tuple[int, int]:
    """Rows of a table and what their vectors take, from the widest of them."""
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    return n, n * (4 * width + 64)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """rank of the k best rows a subject; Spark keeps only k a subject and task before the shuffle."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "code")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _wrong(score):
    return F.when(out_of_bounds(score), F.raise_error(F.lit("invalid cosine similarity values"))).otherwise(clip(score))


def topk_columns(users: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """user_id, rank, code, score; candidates are broadcast, so the caller checks their size."""
    pairs = users.select("user_id", F.col("embedding").alias("u")).crossJoin(F.broadcast(candidates.select("code", F.col("embedding").alias("c"))))
    scored = pairs.select("user_id", "code", _wrong(dot(F.col("u"), F.col("c"))).alias("score"))
    return ranked(scored, k).select("user_id", "rank", "code", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Best:
    """The k best candidates so far of each of some subjects, of which only SUBJECTS by CANDIDATES scores are held at once."""

    def __init__(self, subjects: np.ndarray, k: int):
        self.subjects, self.k = subjects, k
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * len(range(0, len(subjects), SUBJECTS))
        self.least = np.full(len(subjects), -np.inf)

    def add(self, candidates: np.ndarray, codes: np.ndarray) -> None:
        for a in range(0, len(candidates), CANDIDATES):
            for n in range(len(self.found)):
                self._add(n, candidates[a : a + CANDIDATES], codes[a : a + CANDIDATES])

    def _add(self, n: int, candidates: np.ndarray, codes: np.ndarray) -> None:
        subjects, least = self.subjects[n * SUBJECTS :][:SUBJECTS], self.least[n * SUBJECTS :][:SUBJECTS]
        rough, k = subjects @ candidates.T, min(self.k, len(candidates))
        if not np.abs(rough).max() <= 1 + SLACK:  # nor if it isn't a number
            raise ValueError("invalid cosine similarity values")
        np.clip(rough, -1.0, 1.0, out=rough)
        some = rough >= least[:, None] - ROUNDING
        if np.count_nonzero(some) > 4 * k * len(subjects):
            some &= rough >= np.partition(rough, -k, axis=1)[:, [-k]] - ROUNDING
        row, at = np.nonzero(some)
        score, code = np.zeros(len(row)), codes[at]
        for x, y in zip(subjects.T, candidates.T, strict=True):
            score += x[row] * y[at]
        np.clip(score, -1.0, 1.0, out=score)
        if (before := self.found[n]) is not None:
            row, score, code = (np.concatenate(pair) for pair in zip(before, (row, score, code), strict=True))
        order = np.lexsort((code, -score, row))
        row, score, code = row[order], score[order], code[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        least[row[nth == self.k - 1]] = score[nth == self.k - 1]
        self.found[n] = tuple(x[nth < self.k] for x in (row, score, code))

    def table(self, ids: pa.Array, code_type: pa.DataType) -> pa.Table:
        """user_id, code, score of the best, for subjects with these ids."""
        none = (np.zeros(0, np.int64), np.zeros(0), [])
        parts = [(ids.take(pa.array(row + n * SUBJECTS)), pa.array(list(code), code_type), pa.array(score)) for n, (row, score, code) in enumerate(x or none for x in self.found)]
        return pa.concat_tables(pa.table(dict(zip(("user_id", "code", "score"), part, strict=True))) for part in parts) if parts else pa.table({"user_id": ids[:0], "code": pa.array([], code_type), "score": pa.array([], pa.float64())})


def _codes(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist())


def _kinds(users: DataFrame, candidates: DataFrame) -> str:
    return PAIRS.format(user=users.schema["user_id"].dataType.simpleString(), code=candidates.schema["code"].dataType.simpleString())


def topk_arrow(users: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """user_id, rank, code, score by matrix products; the side of fewer rows is broadcast, so the caller checks its size."""
    users, candidates = users.select("user_id", "embedding"), candidates.select("code", "embedding")
    users_are_few = users.count() <= candidates.count()
    few, many = (users, candidates) if users_are_few else (candidates, users)
    table = few.toArrow()
    shared = users.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), table.column(1).combine_chunks()))
    code_type = to_arrow_type(candidates.schema["code"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, embedded = shared.value
        matrix = _matrix(embedded)
        if users_are_few:
            best = Best(matrix, k)
            for batch in batches:
                best.add(_matrix(batch.column(1)), _codes(batch.column(0)))
            yield from best.table(own, code_type).to_batches()
        else:
            codes = _codes(own)
            for batch in batches:
                best = Best(_matrix(batch.column(1)), k)
                best.add(matrix, codes)
                yield from best.table(batch.column(0), code_type).to_batches()

    # Few bytes stand for much work, so a scan's tasks would be too few.
    rows = many.repartition(many.sparkSession.sparkContext.defaultParallelism, many.columns[0])
    return ranked(rows.mapInArrow(score, _kinds(users, candidates)), k).select("user_id", "rank", "code", "score")


def topk_blocks(users: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """user_id, rank, code, score for two large sides: a group a pair of blocks, then the k best of each subject's blocks."""
    counts = [max(1, -(-side.count() // block_rows)) for side in (users, candidates)]
    kinds = _kinds(users, candidates)

    def dealt(side: DataFrame, key: str, own: int, other: int, first: bool) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(own)).cast("int")
        partner = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        rows = side.select(F.col(key), "embedding", block.alias("mine"), partner.alias("theirs"))
        pair = F.col("mine") * other + F.col("theirs") if first else F.col("theirs") * own + F.col("mine")
        return rows.select(pair.cast("long").alias("pair"), key, "embedding")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("user_id").combine_chunks()
        best = Best(_matrix(left.column("embedding")), k)
        if left.num_rows and right.num_rows:
            best.add(_matrix(right.column("embedding")), _codes(right.column("code")))
        return best.table(ids, right.schema.field("code").type)

    us = dealt(users, "user_id", counts[0], counts[1], True).groupBy("pair")
    cs = dealt(candidates, "code", counts[1], counts[0], False).groupBy("pair")
    return ranked(us.cogroup(cs).applyInArrow(score, kinds), k).select("user_id", "rank", "code", "score")


def topk(users: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """The plan that fits the sizes."""
    n, size = measured(candidates)
    checked_k(k, n)
    if min(size, size // n * users.count()) <= SMALL_BYTES:
        return topk_arrow(users, candidates, k)
    return topk_blocks(users, candidates, k)


def with_titles(best: DataFrame, titles: DataFrame) -> DataFrame:
    """Attributes of the winners only, after the k best are known."""
    return best.join(titles, "code", "left")
