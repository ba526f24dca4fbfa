"""Benchmark decontamination by templates.

A text becomes a sequence of words in which numbers, names and units of measure are typed
placeholders: a number is a word that begins with a digit, a name a capitalised word, a unit a
word of UNITS behind a number. Windows of WINDOW (5) words are hashed. A capitalised word that
opens a sentence may be a name or not: a window is hashed in both readings of each such word.
It is hashed in one more reading, in which no word is a name, so that a copy in other case is
found. Any reading may meet any; it stays one window. A window with fewer than LEXICAL (3) other
words says too little as a template; such windows are left out of an item, unless it has no
others: then they are compared literally.

The windows of the documents are hash-joined with those of the benchmark. A document holds an
item if it has at least SIMILARITY (0.8) of the item's distinct windows, and if its slots are
consistent: over the joined windows each value of a slot in the item should meet one value in
the document (the item's "3" always "7", its "Anna" always "Otto"); the share of slot
fillings that do so must reach SIMILARITY too. So a question with new numbers is caught and a
text that merely shares stock phrases isn't.

A window may occur in a document several times, as when it holds an item twice with other values. So slots are judged by
alignment (a row and the distance between the document's and the item's positions): of each window the
occurrence nearest to the alignment counts, over all the windows or over those nearby alone, if
these are enough. The document holds the item if any alignment passes; the best one is reported.

Scale: only windows that pass a bitmap of the benchmark's window hashes leave a document
task. The bitmap has a fixed size (2^24 bits, 2 MB), is built by a group-by and serves any
benchmark; the join behind it is exact. A document that holds an item lacks at most a fifth of
its windows, so it has at least one of any set of more windows than that: documents and
items first meet in the item's rarest such windows alone (``rarest``), which stock phrases shared by
many items are not among, and only these pairs are joined by all their windows. The benchmark side is
broadcast only if it has at most SMALL windows, else Spark joins by shuffle. Nothing is gathered a
document beyond the windows that a benchmark item shares with it, equal fillings once with the places
where they occur. Copies of a row, and of an item, go through once.

Defined results: null texts count as empty and hold nothing; very long texts are read whole; an item of
fewer than five words is one window of its own length, which only a document of just these words
holds; items without any word are never held; every row is judged by its own text, and a doc_id (null
like others) that rows repeat is reported once an item, with the best of them; so is an item_id;
of equal items each is reported; an empty table on either side gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .common import checkpointed, keyed_text

WINDOW, LEXICAL, SIMILARITY = 5, 3, 0.8
MAP_BITS = 24
SMALL = 200_000
#: Units of measure.
UNITS = (
    "km m cm mm mi miles mile ft feet foot in inch inches yd yards kg g mg t lb lbs oz pounds pound grams gram tons ton l ml litres liters "
    "s sec seconds second min minutes minute h hours hour days day weeks week months month years year "
    "dollars dollar euros euro cents cent usd eur gbp percent degrees degree kmh mph watts volts joules"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1F123BB5, 0x2E6D9C71, 0x3A5B7F0D))
STEP = np.uint64(0x9E3779B97F4A7C15)
LITERAL = np.uint64(0x5851F42D4C957F2D)

#: Windows of alignments that are compared at once.
PICKED = 400_000
WINDOWS = "doc_id long, digest binary, pos int, base long, window long, types int, slots array<long>"
_SHAPE = pa.schema([("pos", pa.int32()), ("base", pa.int64()), ("window", pa.int64()), ("types", pa.int32()), ("slots", pa.list_(pa.int64()))])
HELD = "doc_id long, digest binary, item binary, windows long, found long, coverage double, consistency double"
_HELD = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("item", pa.binary()), ("windows", pa.int64()), ("found", pa.int64()), ("coverage", pa.float64()), ("consistency", pa.float64())])


def _unit_hashes() -> np.ndarray:
    data = " ".join(UNITS).encode()
    return np.sort(wordhash.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash)


def _combined(rows: np.ndarray) -> np.ndarray:
    """Order-dependent hash of each row's entries."""
    out = np.full(len(rows), np.uint64(rows.shape[1]))
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            out = (out ^ rows[:, k]) * STEP
            out ^= out >> np.uint64(32)
    return out


def template_windows(data: np.ndarray, offsets: np.ndarray, units: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, pa.RecordBatch]:
    """Rows (counted from the slice's first) and windows of a slice's texts; wanted: a bitmap by the hash's upper bits, or all.

    types has two bits a word of the window: 1 number, 2 name, 3 unit, 0 none; it is -1 for a literal window.
    slots are the hashes of the window's words. base is the hash of the reading in which no word that opens a
    sentence is a name; the window's other readings have rows of their own with the same base.
    """
    w = wordhash.words_of(data, offsets)
    number = w.number
    behind = np.zeros(len(number), bool)
    behind[1:] = number[:-1] & ~w.opens[1:]
    unit = behind & ~number & np.isin(w.hash, units)
    capital = w.capital & ~number & ~unit
    name, open_ = capital & ~w.opens, capital & w.opens
    fixed = number.astype(np.int32) + 3 * unit
    unnamed = np.where(number, NUMBER, np.where(unit, UNIT, w.hash))
    kind, template = fixed + 2 * name, np.where(name, NAME, unnamed)
    counts = np.bincount(w.doc, minlength=len(offsets) - 1)
    firsts = np.cumsum(counts) - counts
    parts: list[tuple[np.ndarray, ...]] = []
    for size in range(1, WINDOW + 1):
        if len(w.hash) < size:
            continue
        if size == WINDOW:
            at = np.flatnonzero(w.doc[: len(w.doc) - size + 1] == w.doc[size - 1 :])
        else:  # texts of just so many words
            at = firsts[counts == size]
        if not len(at):
            continue
        windows_of = lambda x, size=size: np.lib.stride_tricks.sliding_window_view(x, size)
        enough = min(LEXICAL, size)
        lexical = (windows_of(kind)[at] == 0).sum(axis=1)
        spoken = lexical >= enough
        base = np.where(spoken, _combined(windows_of(template)[at]), _combined(windows_of(w.hash)[at]) ^ LITERAL)
        either = windows_of(open_)[at] @ (1 << np.arange(size))

        def take(which: np.ndarray, h: np.ndarray, kinds: np.ndarray, types: np.ndarray | None = None, size=size, at=at, base=base, windows_of=windows_of) -> None:
            if wanted is not None:
                ok = wanted[(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)]
                which, h, kinds = which[ok], h[ok], kinds[ok]
                types = types[ok] if types is not None else None
            if len(which):
                here = at[which]
                shape = (kinds << (2 * np.arange(size, dtype=np.int32))).sum(axis=1).astype(np.int32)
                slots = np.zeros((len(here), WINDOW), np.int64)
                slots[:, :size] = windows_of(w.hash)[here].view(np.int64)
                parts.append((w.doc[here], here - firsts[w.doc[here]], base[which], h, shape if types is None else np.where(types, shape, -1), slots))

        take(np.arange(len(at)), base, windows_of(kind)[at], spoken)
        for named in range(1, 1 << size):
            as_name = (named >> np.arange(size) & 1).astype(bool)
            which = np.flatnonzero(either & named == named)
            which = which[lexical[which] - as_name.sum() >= enough]
            if len(which):
                take(which, _combined(np.where(as_name, NAME, windows_of(template)[at[which]])), np.where(as_name, 2, windows_of(kind)[at[which]]))
        plain = windows_of(name)[at].any(axis=1) & ((windows_of(fixed)[at] == 0).sum(axis=1) >= enough)
        if wanted is None:
            plain &= spoken  # a window that is left out of an item is so in all readings
        which = np.flatnonzero(plain)
        if len(which):
            take(which, _combined(windows_of(unnamed)[at[which]]), windows_of(fixed)[at[which]])
    if not parts:
        return np.zeros(0, np.int64), pa.RecordBatch.from_pylist([], schema=_SHAPE)
    doc, pos, base, h, types, slots = (np.concatenate(c) for c in zip(*parts, strict=True))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1, dtype=np.int32) * WINDOW), pa.array(slots.reshape(-1)))
    return doc, pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int32)), pa.array(base.view(np.int64)), pa.array(h.view(np.int64)), pa.array(types), lists], schema=_SHAPE)


def windows(texts: DataFrame, bitmap=None) -> DataFrame:
    """WINDOWS of a table (doc_id, digest, text); bitmap: a broadcast array of 64-bit words, or None."""
    names = ["doc_id", "digest", *_SHAPE.names]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _unit_hashes()
        wanted = None
        if bitmap is not None:
            wanted = np.unpackbits(np.array(bitmap.value, dtype="<i8").view(np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            for a, data, offsets in wordhash.text_slices(batch.column(2)):
                rows, found = template_windows(data, offsets, units, wanted)
                if len(rows):
                    at = pa.array(rows + a)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *found.columns], names=names)

    return texts.select("doc_id", "digest", "text").mapInArrow(compute, WINDOWS)


def _slot_values(fillings: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """For each filling and word of a window, numbers of the item's value and of the document's; -1 where the word is no slot."""
    item, said = np.full((len(fillings), WINDOW), -1, np.int64), np.full((len(fillings), WINDOW), -1, np.int64)
    known: tuple[dict, dict] = ({}, {})
    for n, f in enumerate(fillings):
        for k in range(WINDOW):
            if f["types"] >> 2 * k & 3:
                item[n, k] = known[0].setdefault(f["item_slots"][k], len(known[0]))
                said[n, k] = known[1].setdefault(f["slots"][k], len(known[1]))
    return item, said


def _shares(picked: np.ndarray, taken: np.ndarray, item: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Of each row of fillings, of which those taken count, the share of slots with the document's most frequent value for the item's."""
    row, column, k = np.nonzero((item[picked] >= 0) & taken[:, :, None])
    of = picked[row, column]
    keys = (row * (item.max() + 2) + item[of, k]) * (said.max() + 2) + said[of, k]
    values, counts = np.unique(keys, return_counts=True)
    slots, first = np.unique(values // (said.max() + 2), return_index=True)
    most = np.maximum.reduceat(counts, first) if len(first) else counts
    agreeing = np.bincount(slots // (item.max() + 2), most, len(picked))
    total = np.bincount(row, minlength=len(picked))
    return np.where(total > 0, agreeing / np.maximum(total, 1), 1.0)


def best_alignment(fillings: list[dict], windows: int, found: int, similarity: float) -> tuple[int, float] | None:
    """(windows found, consistency) of the alignment with the largest consistency, then the most windows, or None if none passes.

    An alignment is a shift of the item against the document. It takes of each window the nearest occurrence, found by
    binary search, once wherever that is and once only within half the item's length. Work and memory go by the
    occurrences, as an item that stands r times has about r alignments, each of its number of windows.
    """
    if not any(f["types"] for f in fillings):
        return found, 1.0
    fillings = sorted(fillings, key=lambda f: (f["types"].bit_count(), f["types"], f["slots"] or [], f["item_slots"] or []))
    item, said = _slot_values(fillings)
    number = np.repeat(np.arange(len(fillings)), [len(f["shifts"]) for f in fillings])
    shift = np.concatenate([f["shifts"] for f in fillings]).astype(np.int64)
    window = np.unique([f["window"] for f in fillings], return_inverse=True)[1][number]
    order = np.lexsort((number, shift, window))
    number, shift, window = number[order], shift[order], window[order]
    first = np.ones(len(shift), bool)
    first[1:] = (shift[1:] != shift[:-1]) | (window[1:] != window[:-1])
    number, shift, window = number[first], shift[first], window[first]
    count = int(window[-1]) + 1
    ends = np.searchsorted(window, np.arange(count + 1))
    alignments, support = np.unique(shift, return_counts=True)
    alignments = alignments[np.argsort(-support, kind="stable")]
    best: tuple[float, int] | None = None
    step = max(1, PICKED // count)
    for at in range(0, len(alignments), step):
        here = alignments[at : at + step]
        picked, far = np.empty((len(here), count), np.int64), np.empty((len(here), count), np.int64)
        for w in range(count):
            places, numbers = shift[ends[w] : ends[w + 1]], number[ends[w] : ends[w + 1]]
            behind = np.searchsorted(places, here)
            left, right = np.maximum(behind - 1, 0), np.minimum(behind, len(places) - 1)
            gaps = np.abs(here - places[left]), np.abs(here - places[right])
            take_left = (gaps[0] < gaps[1]) | ((gaps[0] == gaps[1]) & (numbers[left] <= numbers[right]))
            picked[:, w], far[:, w] = np.where(take_left, numbers[left], numbers[right]), np.minimum(*gaps)
        for taken in (np.ones_like(far, bool), far <= windows // 2):
            held = taken.sum(axis=1)
            enough = np.flatnonzero(held / windows >= similarity)
            if len(enough):
                share = _shares(picked[enough], taken[enough], item, said)
                top = max(zip(share.tolist(), held[enough].tolist(), strict=True))
                if top[0] >= similarity and (best is None or top > best):
                    best = top
        if best == (1.0, found):
            break
    return (best[1], best[0]) if best else None


def rarest(items: DataFrame, totals: DataFrame, similarity: float) -> DataFrame:
    """item, item_window: of each item its windows in the fewest items, one more than a document that holds it may lack."""
    spread = items.select("item", "item_window").distinct()
    shared = spread.groupBy("item_window").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("item").orderBy("shared", "item_window")
    nth = spread.join(shared, "item_window").withColumn("nth", F.row_number().over(order)).join(totals, "item")
    return nth.where(F.col("nth") <= F.col("windows") - F.ceil(similarity * F.col("windows") - 1e-9) + 1).select("item", "item_window")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """HELD: doc_id and digest of a row's text, item (digest of its text), windows (of the item), found, coverage, consistency."""
    spark = docs.sparkSession
    texts = keyed_text(benchmark.select(F.col("item_id").alias("doc_id"), "text")).dropDuplicates(["digest"])
    every = checkpointed(
        windows(texts).select(F.col("digest").alias("item"), F.col("pos").alias("item_pos"), F.col("base").alias("item_window"), "window", F.col("types").alias("item_types"), F.col("slots").alias("item_slots"))
    )
    speaking = every.where("item_types >= 0").select("item").distinct()
    items = checkpointed(every.where("item_types >= 0").unionByName(every.join(speaking, "item", "left_anti")))
    bits = items.select(F.expr(f"shiftrightunsigned(window, {64 - MAP_BITS})").alias("bit")).distinct()
    words = [0] * (1 << (MAP_BITS - 6))
    for row in bits.groupBy(F.expr("cast(bit div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toLocalIterator():
        words[row.word] = row.bits
    bitmap = spark.sparkContext.broadcast(words)
    totals = items.groupBy("item").agg(F.countDistinct("item_window").alias("windows"))
    first = checkpointed(items.join(rarest(items, totals, similarity), ["item", "item_window"]).select("item", "window", "item_types").distinct())
    if items.limit(SMALL + 1).count() <= SMALL:
        items, totals, first = F.broadcast(items), F.broadcast(totals), F.broadcast(first)
    asked = checkpointed(windows(keyed_text(docs), bitmap).drop("base").distinct())
    pairs = asked.join(first, "window").where("types = item_types").select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of"), "item").distinct()
    of_pairs = asked.join(pairs, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of"))).drop("of_id", "of")
    joined = of_pairs.join(items, ["item", "window"]).where("types = item_types")
    slotted = F.col("types") > 0
    met = joined.select(
        "doc_id", "digest", "item", F.col("item_window").alias("window"), F.when(slotted, F.col("types")).otherwise(0).alias("types"), F.when(slotted, F.col("slots")).alias("slots"),
        F.when(slotted, F.col("item_slots")).alias("item_slots"), (F.col("pos") - F.col("item_pos")).alias("shift"),
    )
    fillings = met.groupBy("doc_id", "digest", "item", "window", "types", "slots", "item_slots").agg(F.collect_set("shift").alias("shifts"))
    covered = fillings.groupBy("doc_id", "digest", "item").agg(
        F.countDistinct("window").cast("long").alias("found"), F.collect_list(F.struct("window", "types", "slots", "item_slots", "shifts")).alias("fillings")
    )
    likely = covered.join(totals, "item").where(F.col("found") / F.col("windows") >= similarity).select("doc_id", "digest", "item", "windows", "found", "fillings")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, digest, item, windows, found, gathered = (c[k].as_py() for c in batch.columns)
                verdict = best_alignment(gathered, windows, found, similarity)
                if verdict:
                    yield pa.RecordBatch.from_pylist([dict(zip(_HELD.names, (doc, digest, item, windows, verdict[0], verdict[0] / windows, verdict[1]), strict=True))], schema=_HELD)

    return likely.mapInArrow(judge, HELD)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, windows (of the item), found, coverage, consistency of each item that a document holds."""
    held = contaminated_rows(docs, benchmark, similarity)
    named = keyed_text(benchmark.select(F.col("item_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("item_id"), F.col("digest").alias("item")).distinct()
    best = F.max(F.struct("consistency", "coverage", "found", "windows"))
    return (
        held.join(named, "item").groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.windows", "best.found", "best.coverage", "best.consistency")
    )
