"""Order-preserving packing by dynamic programming.

The token stream of a task's documents, in the table's order, is cut into sequences of at
most ``length`` ids. A cut may lie at a document end (free), at a sentence or line end (cost
SENTENCE) or, every GRID ids in longer stretches, inside a sentence (cost INSIDE); a
sequence costs its padding plus ONE_MORE. Padding fills a sequence up to ``length``, except
where its own length is a power of two. With position p and least cost c of a cut,

    c(j) = cut cost(j) + ONE_MORE + length + min over i (c(i) + p(i)) - p(j),  p(j) - p(i) <= length

and since the lower end of the range only moves up, a monotone queue has each minimum in
constant time. Power-of-two lengths are tried beside it at document ends.

The stream is solved in stretches of about STRETCH ids, so a task holds one stretch; a document of more ids
is solved in one piece with what is before it. The last sequence of a stretch, still open, starts the next one. There is no shuffle: each task packs
what it reads, and sequence ids hold the task's number in their upper bits. A task that
is run again packs the same rows in the same way.

Defined results: null and empty texts are one piece with the end id alone; very long texts are packed whole, cut like
others; of equally cheap cuts the one from the earliest position counts; repeated rows and
null doc_ids are packed like others; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import id_and_text

LENGTH = 1024
SENTENCE, INSIDE, ONE_MORE, GRID = 1, 4, 1, 16
STRETCH = 1 << 20
BATCH_CHARS = 1 << 20
TASK_BITS = 36


def padding(n: int, length: int = LENGTH) -> int:
    return 0 if n & (n - 1) == 0 else length - n


def cut_costs(ends: np.ndarray, doc_ends: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions and costs of all possible cuts of a stream.

    ends: for each id, whether a sentence ends behind it; doc_ends: positions, ascending, the last is the stream's end.
    """
    n = int(doc_ends[-1])
    kind = np.zeros(n + 1, dtype=np.int8)
    kind[1:][ends[:n]] = 1
    kind[doc_ends] = 2
    kind[0] = 2
    marks = np.flatnonzero(kind)
    gaps = np.diff(marks)
    wide = np.flatnonzero(gaps > grid)
    if len(wide):
        each = (gaps[wide] - 1) // grid
        first = np.repeat(np.cumsum(each) - each, each)
        inside = np.repeat(marks[wide], each) + grid * (np.arange(int(each.sum())) - first + 1)
        marks = np.sort(np.concatenate((marks, inside)))
    costs = np.array([INSIDE, SENTENCE, 0])[kind[marks]]
    return marks[1:], costs[1:]


def best_cuts(marks: list[int], costs: list[int], free: list[bool], length: int = LENGTH) -> list[int]:
    """The cheapest series of cuts from 0 to the last mark, by a monotone queue."""
    powers = [1 << k for k in range(length.bit_length() - 1) if 1 << k < length]
    at, cost, back = [0, *marks], [0] * (len(marks) + 1), [0] * (len(marks) + 1)
    where = {0: 0}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, index), rising
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - length:
            queue.popleft()
        least, i = queue[0]
        least += length - p
        if free[j - 1]:
            for size in powers:
                k = where.get(p - size)
                if k is not None and cost[k] < least:
                    least, i = cost[k], k
        c = cost[j] = least + costs[j - 1] + ONE_MORE
        back[j] = i
        where[p] = j
        c += p
        while queue and queue[-1][0] >= c:
            queue.pop()
        queue.append((c, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Feeds on documents and gives pieces: (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, sentence_ends: np.ndarray, first_sequence: int, length: int = LENGTH):
        self.sentence_ends, self.sequence, self.length = sentence_ends, first_sequence, length
        self.docs: list[tuple[int | None, int, bytes, int]] = []  # doc_id, ids gone before, ids, ids in all
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        self.docs.append((doc_id, 0, ids, len(ids) // 4))
        self.held += len(ids) // 4
        return self._solve(False) if self.held >= STRETCH else []

    def finish(self) -> list[tuple]:
        return self._solve(True) if self.docs else []

    def _solve(self, last: bool) -> list[tuple]:
        raw = b"".join(d[2] for d in self.docs)
        ids = np.frombuffer(raw, dtype="<u4")
        doc_ends = np.cumsum([len(d[2]) // 4 for d in self.docs])
        marks, costs = cut_costs(self.sentence_ends[ids], doc_ends)
        cuts = best_cuts(marks.tolist(), costs.tolist(), (costs == 0).tolist(), self.length)
        if not last and len(cuts) > 1:
            cuts.pop()  # its sequence stays open
        upto = cuts[-1]
        sequence_starts = np.array([0, *cuts[:-1]])
        doc_starts = doc_ends - [len(d[2]) // 4 for d in self.docs]
        bounds = np.unique(np.concatenate((sequence_starts, doc_starts[doc_starts < upto], [upto])))
        of_doc = (np.searchsorted(doc_starts, bounds[:-1], side="right") - 1).tolist()
        of_sequence = np.searchsorted(sequence_starts, bounds[:-1], side="right") - 1
        offsets = (bounds[:-1] - sequence_starts[of_sequence]).tolist()
        out = []
        places, firsts = bounds.tolist(), doc_starts.tolist()
        for k, (d, s) in enumerate(zip(of_doc, of_sequence.tolist(), strict=True)):
            a, b = places[k], places[k + 1]
            doc_id, gone, _, total = self.docs[d]
            out.append((doc_id, gone + a - firsts[d], raw[4 * a : 4 * b], total, self.sequence + s, offsets[k]))
        self.sequence += len(cuts)
        rest = []
        for d in range(of_doc[-1], len(self.docs)):
            doc_id, gone, _, total = self.docs[d]
            a, b = max(firsts[d], upto), int(doc_ends[d])
            if a < b:
                rest.append((doc_id, gone + a - firsts[d], raw[4 * a : 4 * b], total))
        self.docs, self.held = rest, sum(len(d[2]) // 4 for d in rest)
        return out


PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, length: int = LENGTH, memory: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian 32-bit words), doc_tokens, sequence_id, offset. memory: chunks that a worker remembers, tokens.MEMORY where not given."""
    end = tokens.ids_bytes([end_id])
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in PIECES.split(", ")]

    def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 4096], strict=True), kinds, strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.encoder(vocabulary, memory)
        packer = Packer(known.sentence_ends(), TaskContext.get().partitionId() << TASK_BITS, length)
        for batch in batches:
            lengths = batch.column(2).to_pylist()
            for a, b in tokens.slices(batch.num_rows, lengths, BATCH_CHARS):
                part = batch.slice(a, b - a)
                for doc_id, ids in zip(part.column(0).to_pylist(), known.encode(part.column(1).to_pylist()), strict=True):
                    yield from rows(packer.add(doc_id, ids + end))
        yield from rows(packer.finish())

    return id_and_text(docs).select("doc_id", "text", F.char_length("text").alias("chars")).mapInArrow(pack, PIECES)
