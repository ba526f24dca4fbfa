"""Token-id files with shuffled planes.

A data set is a folder of shards ``ids-00000.planes``, each a contiguous range of documents in
ascending doc_id order (null ids first). Layout of a shard, all numbers little-endian:

    magic "MLP1"
    blocks: BLOCK ids each (the last one fewer), as 32-bit words; a block is transposed into
        planes, and each plane is one zstandard frame. "byte": 4 planes, plane k holds byte k of every
        word. "bit": 32 planes, plane k holds bit k of every word, eight words a byte, first word lowest.
    chunk index, one zstandard frame of a JSON object: planes, block, n_ids, for each block its
        offset and the size of each plane
    document index, one zstandard frame: n, then n null marks (1 byte), n doc_ids and n token counts (8 bytes)
    tail: offset and size of either index (4 x 8 bytes), magic

A reader can fetch any id range: the chunk index gives the planes' places.

A task writes its shard under a name of its own and then renames it, so that a repeated or
speculative task leaves one whole shard. Memory: one block and one batch of texts a task.

Defined results: null and empty texts have the end id alone; rows that repeat a doc_id, or have none,
stand side by side, ordered by the first 64 characters of the text, and may fill several shards; a very
long text has as many blocks as it needs; an empty table gives an empty data set; other columns are not looked at.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import checked_folder, checkpointed, filesystem, id_and_text, work_dir

MAGIC = b"MLP1"
BLOCK = 1 << 16
LEVEL = 3
BATCH_CHARS = 1 << 20


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    words = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [row.tobytes() for row in np.ascontiguousarray(words.T)]
    bits = np.unpackbits(words, axis=1, bitorder="little")
    return [np.packbits(row, bitorder="little").tobytes() for row in np.ascontiguousarray(bits.T)]


def join_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        words = np.stack([np.frombuffer(p, dtype=np.uint8) for p in parts], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        words = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(words).view("<u4").reshape(-1)


class ShardWriter:
    def __init__(self, sink, planes: str = "byte", block: int = BLOCK):
        self.sink, self.planes, self.block = sink, planes, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[bytes] = []
        self.held = self.n_ids = 0
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.at = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block:
            whole = np.frombuffer(b"".join(self.waiting), dtype="<u4")
            full = len(whole) // self.block * self.block
            for k in range(0, full, self.block):
                self._block(whole[k : k + self.block])
            self.waiting, self.held = [whole[full:].tobytes()], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        place = self.at
        self.chunks.append([place, len(ids), [self._put(self.zip.compress(p)) for p in split_planes(ids, self.planes)]])
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.held:
            self._block(np.frombuffer(b"".join(self.waiting), dtype="<u4"))
        index = json.dumps({"planes": self.planes, "block": self.block, "n_ids": self.n_ids, "chunks": self.chunks}).encode()
        docs = struct.pack("<q", len(self.doc_ids)) + bytes(d is None for d in self.doc_ids)
        docs += np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes() + np.array(self.counts, dtype="<i8").tobytes()
        tail = []
        for part in (index, docs):
            place = self.at
            tail += [place, self._put(self.zip.compress(part))]
        self._put(struct.pack("<4q", *tail) + MAGIC)


class ShardReader:
    def __init__(self, source):
        self.source = source
        source.seek(source.size() - 36)
        tail = source.read(36)
        if tail[32:] != MAGIC:
            raise ValueError("not a whole shard of token ids")
        self.unzip = zstandard.ZstdDecompressor()
        at, size, docs_at, docs_size = struct.unpack("<4q", tail[:32])
        self.index = json.loads(self._frame(at, size))
        docs = self._frame(docs_at, docs_size)
        n = struct.unpack("<q", docs[:8])[0]
        nulls = docs[8 : 8 + n]
        ids = np.frombuffer(docs, dtype="<i8", count=n, offset=8 + n).tolist()
        self.doc_ids = [None if z else d for z, d in zip(nulls, ids, strict=True)]
        self.counts = np.frombuffer(docs, dtype="<i8", count=n, offset=8 + 9 * n)

    def _frame(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.unzip.decompress(self.source.read(size))

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        self.source.seek(at)
        raw = self.source.read(sum(sizes))
        ends = np.cumsum(sizes)
        return join_planes([self.unzip.decompress(raw[e - s : e]) for s, e in zip(sizes, ends, strict=True)], n, self.index["planes"])

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's ids are copied once, out of the blocks that hold them."""
        block, at, k = memoryview(b""), 0, 0
        for doc_id, count in zip(self.doc_ids, self.counts.tolist(), strict=True):
            parts, need = [], 4 * count
            while need:
                if at == len(block):
                    block, at, k = memoryview(self.block(k).view(np.uint8)), 0, k + 1
                parts.append(block[at : at + need])
                at += len(parts[-1])
                need -= len(parts[-1])
            yield doc_id, b"".join(parts)


@dataclass(frozen=True)
class TokenFiles:
    """A written data set: folder and (shard, first id's position in the data set, documents, ids)."""

    folder: str
    shards: list[tuple[str, int, int, int]]


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, planes: str = "byte") -> TokenFiles:
    """Encode all documents and write their ids in ascending doc_id order.

    vocabulary is a tokenizers file that every executor can read. The driver gets one row a shard.
    """
    spark = docs.sparkSession
    folder = checked_folder(spark, folder) if folder else work_dir(spark, "token-ids")
    end = tokens.ids_bytes([end_id])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encode = tokens.encoder(vocabulary).encode
        store, root = filesystem(folder)
        name = f"ids-{part:05d}.planes"
        writer = sink = None
        for batch in batches:
            lengths = batch.column(2).to_pylist()
            for a, b in tokens.slices(batch.num_rows, lengths, BATCH_CHARS):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(f"{root}/.{name}.{attempt}")
                    writer = ShardWriter(sink, planes)
                rows = batch.slice(a, b - a)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "shard": [name], "n_docs": [len(writer.counts)], "n_ids": [writer.n_ids]}, schema=shape)

    shape = pa.schema([("part", pa.int64()), ("shard", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    # Rows of one doc_id, or of none, may fill many shards: of these the text's beginning and then the row decides.
    ranges = ("doc_id", F.substring("text", 1, 64), F.monotonically_increasing_id())
    ordered = id_and_text(docs).repartitionByRange(*ranges).sortWithinPartitions("doc_id", "text")
    written = ordered.select("doc_id", "text", F.char_length("text").alias("chars")).mapInArrow(write, "part long, shard string, n_docs long, n_ids long")
    shards, start = [], 0
    for row in checkpointed(written).orderBy("part").collect():
        shards.append((row.shard, start, row.n_docs, row.n_ids))
        start += row.n_ids
    return TokenFiles(folder, shards)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, ids (little-endian 32-bit words) of every document, from the files."""
    folder, shards = files.folder, files.shards
    known = spark.sparkContext.broadcast(shards)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, start, _, _ = known.value[k]
                with store.open_input_file(f"{root}/{name}") as source:
                    out: list[tuple] = []
                    size = 0
                    for doc_id, ids in ShardReader(source).documents():
                        out.append((doc_id, start, ids))
                        start += len(ids) // 4
                        size += len(ids)
                        if size > 4 << 20:
                            yield rows(out)
                            out, size = [], 0
                    if out:
                        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "ids"])

    n = len(shards)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(read, "doc_id long, start long, ids binary")
