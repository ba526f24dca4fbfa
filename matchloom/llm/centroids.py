"""k-means on integer vectors by Yinyang grouping.

Centroids are put into groups once. Every vector keeps its centroid, an upper bound of the distance to it and one
lower bound a group of the distance to the group's other centroids. When centroids move, the bounds are widened by
how far they moved: a vector whose upper bound stays under all lower bounds keeps its centroid unread (global
filter), else the upper bound is made exact and tried again, and then only groups whose bound is not above the
best distance so far are scanned, exactly (group filter). Bounds are floating point and give way by SLACK; distances
that decide are exact integers, so the result is that of a full scan, ties going to the smaller number.

Vectors are written once as blocks of BLOCK and dealt by block; a round joins them with the small state of the round
before, which alone is checkpointed, and adds up what changed: the vectors that came to and left each centroid.
The driver holds centroids and their sums, nothing that grows with the vectors. Lost executors cost the
blocks that they had cached, which are read again, and one round's tasks.

Defined results: vectors that are null, of another width, or hold a null or non-finite component are left out;
repeated rows each count, as starts too; with fewer vectors than centroids each one is a centroid; a null vec_id is
kept, hashed as if empty; components beyond LARGEST are an error, as their distances would not fit a
long; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, work_dir

SCALE = 1024
LARGEST = 1 << 27
BLOCK = 1024
#: Blocks a partition: a batch of them is 32 MB at 64 components.
TOGETHER = 128
SLACK = 1e-9


def kept_vectors(vectors: DataFrame, width: int, scale: int = SCALE) -> DataFrame:
    """vec_id and ints, floor(scale * x) of every component, of the vectors that count."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    floored = F.transform(e, lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}")).cast("int")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size(e) == width) & finite).select("vec_id", floored.alias("ints"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose SHA-256 of seed:vec_id is least."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "ints").orderBy("mark", "ints").limit(k).collect()
    return np.array([r.ints for r in rows], dtype=np.int64)


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Each centroid's group: k-means over the centroids from evenly spaced ones; numbers without gaps."""
    k = len(centroids)
    points = centroids.astype(float)
    middle = points[np.linspace(0, k - 1, min(groups, k)).astype(int)]
    for _ in range(rounds):
        of = ((points[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        middle = np.array([points[of == g].mean(0) if (of == g).any() else m for g, m in enumerate(middle)])
    return np.unique(of, return_inverse=True)[1]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", gap, gap)


@dataclass
class Bounds:
    """Of one block: centroid, upper bound, and a lower bound for each group."""

    of: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def pack(self) -> bytes:
        return self.of.astype("<i4").tobytes() + self.upper.astype("<f8").tobytes() + self.lower.astype("<f8").tobytes()

    @staticmethod
    def unpack(raw: bytes, n: int) -> Bounds:
        of = np.frombuffer(raw, "<i4", n).copy()
        upper = np.frombuffer(raw, "<f8", n, 4 * n).copy()
        return Bounds(of, upper, np.frombuffer(raw, "<f8", offset=12 * n).reshape(n, -1).copy())


@dataclass
class Move:
    """Centroids, their groups, and how far each has moved since the bounds were made."""

    centroids: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    def started(self, x: np.ndarray) -> Bounds:
        """A full scan."""
        far = np.stack([squared(x, c) for c in self.centroids], axis=1)
        of = far.argmin(1)
        return Bounds(of, *self._bounds(np.sqrt(far.astype(float)), of))

    def _bounds(self, far: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(of))
        upper = far[rows, of]
        others = far.copy()
        others[rows, of] = np.inf
        lower = np.stack([others[:, self.group == g].min(1) for g in range(self.group.max() + 1)], axis=1)
        return upper, lower

    def followed(self, x: np.ndarray, was: Bounds) -> tuple[Bounds, int]:
        """The bounds after the move, and how many distances were computed."""
        groups = range(self.group.max() + 1)
        of, upper = was.of.copy(), was.upper + self.drift[was.of]
        lower = was.lower - np.array([self.drift[self.group == g].max() for g in groups])
        near = lambda r: lower[r].min(1) <= upper[r] + SLACK * (1 + upper[r])
        rows = np.flatnonzero(near(slice(None)))
        computed = len(rows)
        upper[rows] = np.sqrt(squared(x[rows], self.centroids[of[rows]]).astype(float))
        rows = rows[near(rows)]
        if not len(rows):
            return Bounds(of, upper, lower), computed
        old, points = of[rows], x[rows]
        best, best_far = old.copy(), squared(points, self.centroids[old])
        far = np.full((len(rows), len(self.centroids)), np.inf)
        far[np.arange(len(rows)), old] = np.sqrt(best_far.astype(float))
        scanned = np.zeros((len(rows), len(groups)), dtype=bool)
        for g in groups:
            reach = np.sqrt(best_far.astype(float))
            scanned[:, g] = lower[rows, g] <= reach + SLACK * (1 + reach)
            some = np.flatnonzero(scanned[:, g])
            for c in np.flatnonzero(self.group == g):
                exact = squared(points[some], self.centroids[c])
                computed += len(some)
                far[some, c] = np.sqrt(exact.astype(float))
                won = (exact < best_far[some]) | ((exact == best_far[some]) & (c < best[some]))
                best[some[won]], best_far[some[won]] = c, exact[won]
        of[rows] = best
        upper[rows], fresh = self._bounds(far, best)
        # A group that was not scanned keeps its bound, but for the centroid that was left, whose distance is known.
        lower[rows] = np.where(scanned, fresh, np.minimum(lower[rows], fresh))
        return Bounds(of, upper, lower), computed


def _blocks(width: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, width)
            for a in range(0, batch.num_rows, BLOCK):
                ids = batch.column(0).slice(a, BLOCK).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([flat[a : a + BLOCK].tobytes()], pa.binary())], ["block", "ids", "points"]
                )
                block += 1

    return pack


def _round(move: Move, width: int, first: bool):
    """Bounds of every block (block, bounds) and one row a task of what changed (sums): k rows of components and a count."""
    k = len(move.centroids)

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), dtype=np.int64)
        schema = pa.schema([("block", pa.int64()), ("bounds", pa.binary()), ("sums", pa.list_(pa.int64()))])
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_buffer(), "<i4").reshape(-1, width)
                if first:
                    now, changed = move.started(x), np.arange(len(x))
                else:
                    was = Bounds.unpack(batch.column(2)[i].as_py(), len(x))
                    now, _ = move.followed(x, was)
                    changed = np.flatnonzero(now.of != was.of)
                counted = np.concatenate([x[changed].astype(np.int64), np.ones((len(changed), 1), dtype=np.int64)], axis=1)
                np.add.at(sums, now.of[changed], counted)
                if not first:
                    np.subtract.at(sums, was.of[changed], counted)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([now.pack()], pa.binary()), pa.array([None], pa.list_(pa.int64()))], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([sums.reshape(-1)], pa.list_(pa.int64()))], schema=schema)

    return advance


def _final(move: Move, width: int, first: bool):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_buffer(), "<i4").reshape(-1, width)
                now = move.started(x) if first else move.followed(x, Bounds.unpack(batch.column(2)[i].as_py(), len(x)))[0]
                far = squared(x, move.centroids[now.of])
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(3)[i].as_py(), pa.int64()), pa.array(now.of, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return assign


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, groups: int = 3, width: int = 64, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that counts."""
    spark = vectors.sparkSession
    shape = "vec_id long, cluster int, distance long"
    kept = kept_vectors(vectors, width)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{shape}, cluster_inertia long, inertia long, centroid_sha256 string")
    path = work_dir(spark, "vectors")
    kept.mapInArrow(_blocks(width), "block long, ids array<long>, points binary").write.parquet(path)
    written = spark.read.parquet(path)
    parts = max(1, min(spark.sparkContext.defaultParallelism, n := written.count()), n // TOGETHER)
    blocks = written.repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)
    of_group = grouped(centroids, groups)
    totals = np.zeros((len(centroids), width + 1), dtype=object)
    drift = np.zeros(len(centroids))
    bounds: DataFrame | None = None

    def joined() -> DataFrame:
        if bounds is None:
            return blocks.select("block", "points", F.lit(b"").alias("bounds"), "ids")
        return blocks.join(bounds, "block").select("block", "points", "bounds", "ids")

    for _ in range(rounds):
        advance = _round(Move(centroids, of_group, drift), width, bounds is None)
        result = checkpointed(joined().drop("ids").mapInArrow(advance, "block long, bounds binary, sums array<long>"))
        changes = result.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        for at, x in changes.collect():
            totals[divmod(at, width + 1)] += x
        bounds = result.where("block is not null").select("block", "bounds")
        moved = np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(totals, centroids, strict=True)], dtype=np.int64)
        drift = np.sqrt(squared(moved, centroids).astype(float)) * (1 + SLACK)
        centroids = moved
    found = checkpointed(joined().mapInArrow(_final(Move(centroids, of_group, drift), width, bounds is None), shape))
    blocks.unpersist()
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
