"""Texts to unit vectors by an injected encoder.

``HashingEncoder`` is deterministic and needs no file; ``SentenceEncoder`` loads a published model,
if its package is installed, once a Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MODEL_NAME, MODEL_REVISION, WIDTH
from .quality import QualityError, require, require_positive, vectors, violations

#: Bytes of texts that are encoded at once, or one longer text; their words take many times that.
BATCH_BYTES = 1 << 20


class Encoder(Protocol):
    width: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=100_000)
def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:4])


class HashingEncoder:
    """Words hashed to a place (the upper bits of 32) and a sign (the lowest), scaled to unit length; a text without any points along the first axis."""

    def __init__(self, width: int = WIDTH):
        self.width = width

    def encode(self, texts: list[str]) -> np.ndarray:
        found = [re.findall(r"\w+", text.lower()) for text in texts]
        numbers: dict[str, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int64)
        hashes = np.array([word_hash(w) for w in numbers], dtype=np.int64)[ids] if len(ids) else ids
        row = np.repeat(np.arange(len(texts)), [len(words) for words in found])
        points = np.bincount(row * self.width + (hashes >> 1) % self.width, np.where(hashes & 1, 1.0, -1.0), len(texts) * self.width)
        out = points.reshape(len(texts), self.width)
        out[~out.any(axis=1), 0] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


class SentenceEncoder:
    width = WIDTH

    def __init__(self, model: str = MODEL_NAME, revision: str = MODEL_REVISION):
        self.model, self.revision, self._loaded = model, revision, None

    def __getstate__(self):
        return {"model": self.model, "revision": self.revision, "_loaded": None}

    def encode(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as error:
                raise QualityError("sentence_transformers is not installed; it is needed to encode with a published model") from error
            self._loaded = SentenceTransformer(self.model, revision=self.revision)
        return self._loaded.encode(texts, convert_to_numpy=True, normalize_embeddings=True).astype(np.float32)


def in_turn(texts: pa.Array, batch_size: int) -> Iterator[list[str]]:
    """Lists of at most batch_size texts, nulls empty, and of BATCH_BYTES or one longer text; the rest of a batch stays as it came."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first = held = 0
    for n, size in enumerate(sizes):
        if n > first and (n - first == batch_size or held + size > BATCH_BYTES):
            yield pc.fill_null(texts.slice(first, n - first), "").to_pylist()
            first, held = n, 0
        held += size
    if first < len(sizes):
        yield pc.fill_null(texts.slice(first), "").to_pylist()


def encode(rows: DataFrame, encoder: Encoder, text: str = "profile_text", batch_size: int = 32) -> DataFrame:
    """rows with a column embedding; ids travel with their vectors, so order doesn't matter."""
    require_positive(batch_size=batch_size)

    @F.arrow_udf(T.ArrayType(T.FloatType(), False))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [encoder.encode(texts) for texts in in_turn(batch, batch_size)]
            flat = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0, np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * encoder.width, pa.int32()), pa.array(flat, pa.float32()))

    return rows.withColumn("embedding", run(F.col(text)))


def checked(encoded: DataFrame, key: str, width: int) -> DataFrame:
    require(violations(vectors(encoded, key, width, 2e-5)))
    return encoded
