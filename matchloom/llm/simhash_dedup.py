"""SimHash near-duplicates by segment popcounts and a grid range join.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, its 4-word
shingles (fewer words: the whole sequence), repeats included, joined by one blank; a bit is
1 if it is set in over half of the shingles' XXH64 (UTF-8, seed 42). No words: zero.

Two fingerprints link if they differ in at most RADIUS (4) bits. To find all such pairs:

1. equal fingerprints are one point, kept once with its smallest doc_id;
2. each point is embedded as the vector of its 32 popcounts over 2-bit segments. The
   Manhattan distance of two vectors is a lower bound of the Hamming distance, so only
   pairs within Manhattan distance 4 matter;
3. grid range join: the 32 coordinates fall into g groups. Within distance 4 at most four
   groups differ at all, so g - 4 of them agree: points meet in C(g, 4) grid cells (the
   agreeing groups and their coordinates). More groups make more cells a point and fewer
   points a cell; ``groups_for`` weighs both by the number of points, so work
   stays near proportional from thousands of points (g = 5) to billions (g = 10). Any g is exact;
4. inside a cell the pairs pass the Manhattan bound, then the exact Hamming distance.

Pairs are never listed. A cell hands on only a spanning forest of its links, at most one
edge fewer than its points. Cells come sorted by Spark and go through a task in small
pieces. A cell with more than DEEP points, as around a template, is divided again: what its points don't
agree in yet falls into FINER groups, and they meet where FINER - 4 of these agree. A cell that still has
more than CELL points is split: its points are dealt into blocks and each pair of blocks is a piece
of work of its own, at most 2 * CELL points, so a cell of any size is compared in full with bounded
memory in many tasks. Connected components of the forests then give the classes.

Defined results: null text counts as empty; very long texts are read whole; texts without words have fingerprint zero and
link with each other and with any fingerprint near zero; a null doc_id gets its class from
the others and is never the smallest (a class of null ids alone has a null component);
repeated rows each give their row; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text, keyed_text
from .components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
SEGMENT_BITS = 2
CELL, FINER = 2048, 8
#: Points of a cell from which on finer cells (each point in comb(FINER, RADIUS) of them) are fewer rows than pairs of blocks.
DEEP = 2 * CELL * comb(FINER, RADIUS)
#: Bits that the popcount of a random 2-bit segment tells apart pairs by; comparisons that cost as much as a row.
TELLING, ROW_COST = 1.415, 200


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        h = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        h = [digest(line[s:e], SEED) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    hashes = np.array(h, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(texts: DataFrame) -> DataFrame:
    """The other columns of a table with text and fp, the fingerprint as a signed long."""
    others = texts.drop("text")
    width = len(others.columns)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t) for t in batch.column(width).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:width], "fp"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others.schema)
    return texts.select(*others.columns, "text").mapInArrow(compute, f"{schema}, fp long")


def groups_for(points: int) -> int:
    """The number of groups with the least work for so many points."""

    def work(g: int) -> float:
        a_cell = points / 2 ** (TELLING * 64 / SEGMENT_BITS * (g - RADIUS) / g)
        return comb(g, RADIUS) * (1 + a_cell / 2 / ROW_COST)

    return min(range(RADIUS + 1, RADIUS + 7), key=work)


def group_masks(groups: int, segments: list[int] | None = None) -> list[int]:
    """Bits of each group of whole segments, of all or of some."""
    segments = list(range(64 // SEGMENT_BITS)) if segments is None else segments
    cuts = [round(len(segments) * k / groups) for k in range(groups + 1)]
    return [sum(((1 << SEGMENT_BITS) - 1) << SEGMENT_BITS * s for s in segments[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def agreeing_masks(groups: list[int]) -> list[int]:
    """Bits that agree in each grid: all groups but RADIUS."""
    return [sum(some) for some in combinations(groups, len(groups) - RADIUS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The popcount of each 2-bit segment as a row of ones: 00, 01 or 11. Manhattan distance counts differing bits."""
    odd = np.uint64(0x5555555555555555)
    other = fp >> np.uint64(1)
    return ((fp | other) & odd) | (((fp & other) & odd) << np.uint64(1))


def _cells(points: DataFrame, groups: int) -> DataFrame:
    """fp in each of its grid cells: grid, key (of grid and cell), packed (the popcounts), computed by DataFrame functions.

    Keys are hashes: two cells with one key are compared together, which finds no more than the links there are.
    """
    odd = 0x5555555555555555
    packed = F.expr(
        f"((fp | shiftrightunsigned(fp, 1)) & {odd}L) | shiftleft(fp & shiftrightunsigned(fp, 1) & {odd}L, 1)"
    )
    masks = map(_signed, agreeing_masks(group_masks(groups)))
    cells = F.array(*[F.struct(F.lit(k).alias("grid"), F.col("packed").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)])
    return points.withColumn("packed", packed).select("fp", "packed", F.inline(cells)).select("fp", "packed", "grid", F.xxhash64("grid", "cell").alias("key"))


def _finer_cells(cells: DataFrame, groups: int) -> DataFrame:
    """cells divided by what their points don't agree in yet; a small table, at most 210 * 70 rows, has the bits."""
    rows = []
    for grid, mask in enumerate(agreeing_masks(group_masks(groups))):
        rest = [s for s in range(64 // SEGMENT_BITS) if not mask >> SEGMENT_BITS * s & 1]
        rows += [(grid, n, _signed(m)) for n, m in enumerate(agreeing_masks(group_masks(FINER, rest)))]
    bits = cells.sparkSession.createDataFrame(rows, "grid int, part int, bits long")
    return cells.join(F.broadcast(bits), "grid").select("fp", "packed", "grid", F.xxhash64("key", "part", F.col("packed").bitwiseAND(F.col("bits"))).alias("key"))


def _over(cells: DataFrame, most: int) -> DataFrame:
    """key, n of the cells with more points than that."""
    return checkpointed(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))


def links_in_cells(keys: np.ndarray, sides: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each run of equal keys (sorted): two arrays of fingerprints.

    sides: 0 compares with all, 1 with 2 only and 2 with 1 only (a pair of blocks).
    """
    n = len(fps)
    packed = popcounts(fps)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.repeat(np.concatenate((starts[1:], [n])), np.diff(np.concatenate((starts, [n]))))
    label = np.arange(n)
    heads: list[np.ndarray] = []
    tails: list[np.ndarray] = []
    active = np.arange(n)
    step = 1
    while True:
        active = active[active + step < ends[active]]
        if not len(active):
            break
        i, j = active, active + step
        open_ = (label[i] != label[j]) & ((sides[i] == 0) | (sides[i] != sides[j]))
        i, j = i[open_], j[open_]
        if len(i):
            near = np.bitwise_count(packed[i] ^ packed[j]) <= radius  # Manhattan distance
            i, j = i[near], j[near]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            new_i: list[int] = []
            new_j: list[int] = []
            for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                x, y = a, b
                while label[x] != x:
                    label[x] = label[label[x]]
                    x = label[x]
                while label[y] != y:
                    label[y] = label[label[y]]
                    y = label[y]
                if x != y:
                    label[max(x, y)] = min(x, y)
                    new_i.append(a)
                    new_j.append(b)
            if new_i:
                heads.append(fps[new_i])
                tails.append(fps[new_j])
                for _ in range(64):  # to roots, so that linked points are told at a glance
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
        step += 1
    if not heads:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(heads), np.concatenate(tails)


def link_edges(points: DataFrame, cell: int = CELL, groups: int | None = None, deep: int = DEEP) -> DataFrame:
    """a, b: edges between distinct fingerprints (column fp) whose components are those of all links."""
    groups = groups or groups_for(points.count())
    cells = _cells(points, groups)
    crowded = _over(cells, cell)
    large = crowded.where(F.col("n") > deep)
    if not large.isEmpty():
        cells = cells.join(large, "key", "left_anti").unionByName(_finer_cells(cells.join(large, "key").drop("n"), groups))
        crowded = _over(cells, cell)
    work = cells.select("key", F.lit(0).cast("byte").alias("side"), "fp")
    if not crowded.isEmpty():
        # Every point of a crowded cell has a block and goes to each pair of blocks with its own in it.
        blocks = crowded.select("key", F.ceil(F.col("n") / cell).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = cells.join(blocks, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = dealt.select(
            F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
            F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"),
            "fp",
        )
        work = work.join(blocks, "key", "left_anti").unionByName(pairs)
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64))
        for batch in batches:
            columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            k, s, f = (np.concatenate((h, c)) for h, c in zip(held, columns, strict=True))
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            held = (k[cut:], s[cut:], f[cut:])
            yield edges(*links_in_cells(k[:cut], s[:cut], f[:cut]))
        yield edges(*links_in_cells(*held))

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=shape)

    return work.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """fp, class (its smallest fingerprint) and component_id of every distinct fingerprint of a table (doc_id, fp)."""
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = connected_components(link_edges(points.select("fp")))
    named = points.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    least = named.where("component is not null").groupBy("component").agg(F.min("least").alias("component_least"))
    return named.join(least, "component", "left").select("fp", "class", F.coalesce("component_least", "least").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    prints = checkpointed(fingerprints(id_and_text(docs)))
    return prints.join(classes(prints).drop("class"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def judged_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest, stays, n: which distinct rows (doc_id and text's digest) are their class's first, and how often they occur.

    The first of a class has its smallest doc_id (a null one comes last), of rows with that the smallest digest.
    """
    prints = checkpointed(fingerprints(keyed_text(docs)))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    rows = prints.groupBy("doc_id", "digest", "fp").agg(F.count(F.lit(1)).alias("n")).join(classes(prints).drop("component_id"), "fp")
    rows = checkpointed(rows.withColumn("row", row).select("row", "class", "n"))
    first = rows.groupBy("class").agg(F.min("row").alias("first"))
    return rows.join(first, "class").select("row.doc_id", "row.digest", (F.col("row") == F.col("first")).alias("stays"), "n")
