"""Phrases that follow themselves, and normalisation, which takes them out.

Spark has no operator for runs inside a row, so this is a vector function on batches: words become numbers, for
every distance k the places where a word equals the one k places on are found at once, and only where k - 1 of
them stand side by side can a phrase of k words repeat.
"""

from __future__ import annotations

import itertools
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import scrub

#: Fixed value: words of the longest phrase that is looked for; the shortest has two.
LONGEST_REPEAT = 16
#: Bytes of texts whose words a task holds at once, or one longer text; words take some thirty times that.
SLICE_BYTES = 1 << 20


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"


def _opens(word: str, end: str) -> bool:
    """Whether end, which the word ends in, begins at a word boundary of it."""
    inside = len(word) - len(end)
    return _in_word(end[0]) if not inside else _in_word(word[inside - 1]) != _in_word(word[inside])


def _starts(ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Ascending places i, each with a length k, where words i + 1 to i + k - 1 stand again k places on."""
    found = []
    for k in range(2, LONGEST_REPEAT + 1):
        same = ids[:-k] == ids[k:]
        if len(same) >= k - 1 and same.any():
            sums = np.concatenate([[0], np.cumsum(same)])
            at = np.flatnonzero(sums[k - 1 :] - sums[: len(sums) - k + 1] == k - 1)
            found.append(np.stack([at - 1, np.full(len(at), k)], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), int)
    pairs = pairs[pairs[:, 0] >= 0]
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return pairs[:, 0].tolist(), pairs[:, 1].tolist()


def _shorter(texts: Sequence[list[str]]) -> dict[int, list[str]]:
    """The texts that lose something by one pass: the leftmost phrases, at a place the one that begins first in its word, then the longest."""
    words: list[str] = []
    begins = [0]
    for text in texts:
        whole = " ".join(text)
        words += (whole.lower() if whole.isascii() else whole.upper().lower()).split(" ")
        words.append("\n")  # equals nothing, as its number is taken once
        begins.append(len(words))
    numbers: dict[str, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    ids[np.array(begins[1:], dtype=np.int64) - 1] = -1 - np.arange(len(texts))
    gone: dict[int, list[tuple[int, int]]] = {}
    starts, lengths = _starts(ids)
    at = 0
    while at < len(starts):
        i = starts[at]
        best, head = (0, 0), words[i]
        while at < len(starts) and starts[at] == i:
            again = words[i + lengths[at]]
            if again != "\n" and again and head.endswith(again) and _opens(head, again):
                best = max(best, (len(again), lengths[at]))
            at += 1
        if k := best[1]:
            text = bisect_right(begins, i) - 1
            gone.setdefault(text, []).append((i + k - begins[text], i + 2 * k - begins[text]))
            at = bisect_left(starts, i + 2 * k, at)
    out = {}
    for text, parts in gone.items():
        kept, upto = [], 0
        for first, behind in parts:
            kept += texts[text][upto:first]
            upto = behind
        out[text] = kept + texts[text][upto:]
    return out


def without_repeats(texts: Iterable[str], passes: int = 3) -> list[str]:
    """Collapsed texts in which a phrase of 2 to 16 words that follows itself, in any case, stands once; later passes see what an earlier one has changed."""
    done = list(texts)
    some = {n: words for n, t in enumerate(done) if len(words := t.split(" ")) > 3}
    for _ in range(passes):
        numbers = list(some)
        shorter = _shorter([some[n] for n in numbers])
        some = {numbers[n]: words for n, words in shorter.items()}
        for n, words in some.items():
            done[n] = " ".join(words)
        if not some:
            break
    return done


def _in_slices(texts: pa.Array) -> pa.Array:
    """without_repeats of an array, slice by slice, so that the words of a whole batch are never in memory at once."""
    behind = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    done, first = [], 0
    while first < len(texts):
        before = behind[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(behind, before + SLICE_BYTES, "right")))
        done.append(pa.array(without_repeats(texts.slice(first, last - first).to_pylist()), texts.type))
        first = last
    return pa.concat_arrays(done) if done else texts


def _of_texts(texts: pa.Array) -> pa.Array:
    return _in_slices(texts)


def _of_lists(rows: pa.Array) -> pa.Array:
    """The same for every text of an array of lists of lists, without nulls."""
    units = rows.flatten()
    lists = pa.ListArray.from_arrays(_offsets(units), _in_slices(units.flatten()))
    return pa.ListArray.from_arrays(_offsets(rows), lists)


def _offsets(lists: pa.Array) -> pa.Array:
    """Where each list begins in flatten(), and where the last one ends."""
    return pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]), pa.int32())


def collapse_repeats(text: Column) -> Column:
    """without_repeats of a column of texts that aren't null."""
    return F.arrow_udf(_of_texts, "string")(text)


def collapse_repeats_each(lists: Column) -> Column:
    """without_repeats of every text of a column of lists of lists."""
    return F.arrow_udf(_of_lists, "array<array<string>>")(lists)


def normalize(text: Column) -> Column:
    return collapse_repeats(scrub(text))
