"""Words of many texts at once and their hashes, by numpy over Arrow's own bytes.

A word is a run of letters, digits and bytes of other scripts; a point or comma between two
digits belongs to it. Its hash is a polynomial in its bytes (A-Z and the capital Latin-1
letters lower-cased) modulo 2^64, mixed afterwards. Work is done in slices of about a
megabyte, so memory doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Multipliers of the hash.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LOW_BITS = 12

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.concatenate(([np.uint64(1)], np.full((1 << LOW_BITS) - 1, BASE))), dtype=np.uint64)
    _STRIDE = _POWERS[-1] * BASE


def powers(k: np.ndarray) -> np.ndarray:
    """BASE to each of the exponents, for words of any length."""
    most = int(k.max(initial=0))
    if most < 1 << LOW_BITS:
        return _POWERS[k]
    with np.errstate(over="ignore"):
        high = np.cumprod(np.concatenate(([np.uint64(1)], np.full(most >> LOW_BITS, _STRIDE))), dtype=np.uint64)
        return _POWERS[k & ((1 << LOW_BITS) - 1)] * high[k >> LOW_BITS]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of row ranges of about `most` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@dataclass
class Words:
    """Arrays with an entry a word, in order; doc counts from the slice's first row."""

    doc: np.ndarray
    hash: np.ndarray
    number: np.ndarray
    capital: np.ndarray
    opens: np.ndarray
    _bytes: np.ndarray
    _starts: np.ndarray
    _lengths: np.ndarray
    _places: np.ndarray

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than size bytes and the hashes of their first size bytes."""
        long = np.flatnonzero(self._lengths > size)
        if not len(long):
            return long, np.zeros(0, np.uint64)
        at = self._starts[long][:, None] + np.arange(size)
        with np.errstate(over="ignore"):
            h = ((self._bytes[at].astype(np.uint64) + np.uint64(1)) * _POWERS[:size]).sum(axis=1, dtype=np.uint64)
            return long, mix(h + np.uint64(size))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    inside = _LETTER[data]
    if n > 2:
        digit = _DIGIT[data]
        inside[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    m = len(starts)
    low = _LOWER[data]
    if n > 1:
        capital2 = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital2] += 0x20
    doc = np.searchsorted(offsets, starts, side="right") - 1
    if not m:
        none = np.zeros(0, bool)
        return Words(doc, np.zeros(0, np.uint64), none, none, none, low[:0], starts, starts, starts)
    kept = low[inside]
    places = np.cumsum(inside)
    wstarts = places[starts] - 1
    lengths = np.diff(np.concatenate((wstarts, [len(kept)])))
    k = np.arange(len(kept)) - np.repeat(wstarts, lengths)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((kept.astype(np.uint64) + np.uint64(1)) * powers(k), wstarts)
        h = mix(h)
    lead = data[starts]
    capital = (lead >= 65) & (lead <= 90)
    if n > 1:
        capital |= (starts + 1 < n) & (lead == 0xC3) & (low[np.minimum(starts + 1, n - 1)] != data[np.minimum(starts + 1, n - 1)])
    ended = np.concatenate(([0], np.cumsum(_END[data])))
    opens = np.ones(m, bool)
    opens[1:] = (ended[starts[1:]] > ended[starts[:-1] + lengths[:-1]]) | (doc[1:] != doc[:-1])
    return Words(doc, h, _DIGIT[lead], capital, opens, kept, wstarts, lengths, places)
