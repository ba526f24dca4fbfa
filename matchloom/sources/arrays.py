"""Dense two-dimensional ``.npy`` arrays as a Spark data source.

Reading: the header tells where every row lies, so partitions are ranges of rows of about PIECE bytes, each read
by its own task. Writing: rows with dense numbers go to their places. Where the store lets a file be written at any
place, all tasks write into one hidden file; elsewhere each writes hidden pieces, which the driver strings together
without holding more than a buffer. Only the commit gives the file its name; a failed job leaves none. Repeated or
speculative tasks write the same bytes to the same places, or pieces of their own.
"""

from __future__ import annotations

import ast
import io
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .stores import filesystem

MAGIC = b"\x93NUMPY"
PIECE = 64 << 20
BUFFER = 8 << 20


@dataclass(frozen=True)
class Layout:
    """Where the rows of an array lie in its file."""

    dtype: str
    by_column: bool
    rows: int
    width: int
    offset: int

    @staticmethod
    def of(source) -> Layout:
        head = source.read(8)
        if head[:6] != MAGIC:
            raise ValueError("not a .npy array")
        size = struct.unpack("<H", source.read(2))[0] if head[6] == 1 else struct.unpack("<I", source.read(4))[0]
        said = ast.literal_eval(source.read(size).decode("latin1" if head[6] < 3 else "utf8"))
        dtype = np.dtype(said["descr"])
        if dtype.hasobject:
            raise ValueError("pickled content is refused")
        if len(said["shape"]) != 2 or dtype.kind not in "fiub":
            raise ValueError(f"expected a two-dimensional array of numbers, found {len(said['shape'])} dimensions of {dtype}")
        return Layout(dtype.str, said["fortran_order"], *said["shape"], source.tell())

    def read(self, source, start: int, end: int) -> np.ndarray:
        """Rows start to end as 32-bit floats."""
        item, count = np.dtype(self.dtype).itemsize, end - start
        if not self.by_column:
            source.seek(self.offset + start * self.width * item)
            return np.frombuffer(source.read(count * self.width * item), self.dtype).reshape(count, self.width).astype("<f4")
        columns = []
        for c in range(self.width):
            source.seek(self.offset + (c * self.rows + start) * item)
            columns.append(np.frombuffer(source.read(count * item), self.dtype))
        return np.stack(columns, axis=1).astype("<f4") if columns else np.zeros((count, 0), "<f4")


@dataclass
class Rows(InputPartition):
    start: int
    end: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def _open(self):
        store, path = filesystem(self.path)
        return store.open_input_file(path)

    def partitions(self) -> list[Rows]:
        with self._open() as source:
            self.layout = Layout.of(source)
        step = max(1, self.piece // max(1, self.layout.width * np.dtype(self.layout.dtype).itemsize))
        return [Rows(a, min(a + step, self.layout.rows)) for a in range(0, self.layout.rows, step)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        with self._open() as source:
            layout = Layout.of(source)
            step = max(1, BUFFER // max(4, 4 * layout.width))
            for a in range(part.start, part.end, step):
                x = layout.read(source, a, b := min(a + step, part.end))
                ends = pa.array(np.arange(b - a + 1, dtype="<i4") * layout.width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a + 1, b + 1)), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], ["pos", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    """(first row, rows, name of the piece or nothing) of each run of rows."""

    runs: list


class ArrayWriter(DataSourceArrowWriter):
    """at (from 0, dense over the job) and embedding, sorted inside a task, as rows of an array of known shape."""

    def __init__(self, path: str, rows: int, width: int, job: str, pieces: bool):
        self.path, self.rows, self.width, self.job, self.pieces = path, rows, width, job, pieces

    def _hidden(self):
        store, path = filesystem(self.path)
        folder, name = os.path.split(path)
        return store, path, f"{folder}/.{name}.{self.job}"

    def _header(self) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (self.rows, self.width)})
        return out.getvalue()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, _, hidden = self._hidden()
        put = self._pieces(store, hidden) if self.pieces else self._places(hidden)
        runs: list = []
        next(put)
        for batch in batches:
            at = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(at), self.width)
            for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else []:
                name = put.send((int(at[rows[0]]), x[rows].tobytes()))
                if runs and runs[-1][2] == name and runs[-1][0] + runs[-1][1] == at[rows[0]]:
                    runs[-1][1] += len(rows)
                else:
                    runs.append([int(at[rows[0]]), len(rows), name])
        put.close()
        return Written(runs)

    def _places(self, hidden: str):
        """Writes into one file for all tasks."""
        base, row = len(self._header()), 4 * self.width
        file = os.open(hidden, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            done = None
            while True:
                at, data = yield done
                done, place = "", base + at * row
                for a in range(0, len(data), BUFFER):
                    part = data[a : a + BUFFER]
                    if os.pwrite(file, part, place + a) != len(part):
                        raise OSError(f"no space for {self.path}")
        finally:
            os.fsync(file)
            os.close(file)

    def _pieces(self, store, hidden: str):
        """Writes a file for each run of rows; a task's next run opens a new one where it doesn't follow the last."""
        sink, name, behind, done = None, "", -1, None
        store.create_dir(hidden, recursive=True)
        try:
            while True:
                at, data = yield done
                if sink is None or at != behind:
                    if sink is not None:
                        sink.close()
                    name = f"{at:020d}-{TaskContext.get().taskAttemptId()}"
                    sink = store.open_output_stream(f"{hidden}/{name}")
                sink.write(data)
                behind, done = at + (len(data) // (4 * self.width) if self.width else 0), name
        finally:
            if sink is not None:
                sink.close()

    def commit(self, messages: list) -> None:
        store, path, hidden = self._hidden()
        runs = sorted(r for m in messages if m is not None for r in m.runs)
        at = 0
        for start, count, _ in runs:
            if start != at:
                break
            at += count
        if at != self.rows and self.width:
            self.abort(messages)
            raise ValueError(f"rows {at + 1} and on are missing or repeated")
        if self.pieces:
            with store.open_output_stream(f"{hidden}.whole") as out:
                out.write(self._header())
                for _, _, name in runs:
                    with store.open_input_stream(f"{hidden}/{name}") as piece:
                        while part := piece.read(BUFFER):
                            out.write(part)
            store.move(f"{hidden}.whole", path)
            self.abort(messages)
            return
        file = os.open(hidden, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            os.pwrite(file, self._header(), 0)
            os.fsync(file)
        finally:
            os.close(file)
        os.replace(hidden, path)

    def abort(self, messages: list) -> None:
        """What is hidden goes."""
        from pyarrow import fs

        store, _, hidden = self._hidden()
        for name in (hidden, f"{hidden}.whole"):
            kind = store.get_file_info(name).type
            if kind == fs.FileType.Directory:
                store.delete_dir(name)
            elif kind == fs.FileType.File:
                store.delete_file(name)


class ArraySource(DataSource):
    """Options: path; piece (bytes a partition); for writing rows, width, job and pieces."""

    @classmethod
    def name(cls) -> str:
        return "dense_array"

    def schema(self) -> str:
        return "pos long, embedding array<float>"

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options["path"], int(self.options.get("piece", PIECE)))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        o = self.options
        return ArrayWriter(o["path"], int(o["rows"]), int(o["width"]), o["job"], o["pieces"] == "true")
