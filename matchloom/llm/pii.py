"""Personal data by bootstrapped contextual extraction.

1. Seeds: e-mail addresses, IP addresses, card and phone numbers found by fixed rules. These
   base spans always stay.
2. Patterns: a mention is a seed, or a word with four digits or an @ in it that no seed covers, or such
   words between blanks that together are one number in groups (``_RUN``). Its form says which kinds it
   may be (``possible_kinds``). The words around it, within REACH characters, give up to four lexical
   patterns: two words before, one before, one behind, one on either side.
3. Graph: patterns and instances (the distinct values of mentions) are scored in turn for each kind, as
   far as patterns have SEEDS distinct seeds of one. A pattern's confidence is the mean score of its
   instances. A seed's score is 1 for its kind and 0 for the others; another instance's is the damped mean
   of its patterns' confidence, 0 at first and for kinds that its form rules out. Turns go on until no
   confidence moves by TOLERANCE; more than TURNS of them, which damping rules out, are an error.
4. Patterns of CONFIDENCE or more, with SEEDS distinct seeds of the kind, are trusted: their instances
   that may be of the kind are found.
5. Generations: what was found counts as a seed from now on, so that it can vouch for patterns that no
   seed of the fixed rules has, and 3 and 4 are done again, until nothing new is found.
6. The mentions that no seed covers, in trusted patterns, are added to the spans under the kind's name.

The graph never leaves Spark. It holds a row a distinct (pattern, instance), found by
map-side combining, so a hot pattern or value is one row a task. Patterns with fewer than SEEDS
instances of any sort can never be trusted and leave before. Trusted patterns are broadcast only up
to SMALL of them.

Positions are code points, end exclusive. Texts are read whole, in one pass.

Defined results: null and empty texts have no span; very long texts are read whole; a null doc_id and
repeated rows each give their row; spans that begin at one place come in the order of KINDS; of a mention's
trusted patterns the most confident names the kind, of equal ones the first kind; an empty table gives
none; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text, spans_text

KINDS = ["email", "ip", "card", "phone"]
REACH, SEEDS, CONFIDENCE, TOLERANCE, TURNS, DAMPING, GENERATIONS = 64, 5, 0.8, 1e-4, 300, 0.9, 200
#: Every so many turns it is looked at what the last one has moved.
LOOK = 4
SMALL = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match ends where its digits end, so no match begins inside a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPECIAL = re.compile(r"[0-9]+|@")
#: Groups of up to six digits or masking characters with single blanks, at most LONGEST_RUN characters without the marks.
_GROUP = r"[0-9xX*]{1,6}"
_WORD = rf"(?:\({_GROUP}\)|{_GROUP})(?:[-./]{_GROUP})*"
_RUN = re.compile(rf"(?<![^\s\"'\[<]){_WORD}(?:[ \t\u00a0]{_WORD})+(?=[\"'\])>,.;:!?]*(?:\s|$))")
SHORTEST_RUN, LONGEST_RUN = 7, 19
_EDGE = "\"'()[]{}<>,;:!?.*#&%$|"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is all it can be before the first @ that a domain follows."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the seeds."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def number_runs(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Numbers in groups between blanks that no span touches."""
    k = 0
    for m in _RUN.finditer(text):
        signs = len(re.findall(r"[0-9xX*]", m[0]))
        if not SHORTEST_RUN <= signs <= LONGEST_RUN or sum(c in "0123456789" for c in m[0]) < 4 or not possible_kinds(m[0]):
            continue
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k == len(spans) or spans[k][0] >= m.end():
            yield m.span()


def other_mentions(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words with four digits or an @, and numbers in groups, that no seed touches."""
    spans = sorted((s, e) for s, _, e in taken)
    runs = list(number_runs(text, spans))
    yield from runs
    spans = sorted(spans + runs)
    k = done = 0
    for m in _SPECIAL.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        done = b
        word = text[a:b]
        a += len(word) - len(word.lstrip(_EDGE))
        b -= len(word) - len(word.rstrip(_EDGE))
        if a >= b or (sum(c in "0123456789" for c in text[a:b]) < 4 and "@" not in text[a:b]):
            continue
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k == len(spans) or spans[k][0] >= b:
            yield a, b


def possible_kinds(word: str) -> int:
    """A bit a kind: @ for mail; two separators and hex digits for addresses; twelve digits for
    cards and four for phones, without letters but a leading x, ext or tel and masking x.
    """
    digits, letters = sum(c in "0123456789" for c in word), "".join(c for c in word.lower() if c.isalpha())
    mail = "@" in word
    address = not mail and len(re.findall("[.:]", word)) >= 2 and set(letters) <= set("abcdef")
    few = letters in ("", "x", "ext", "tel")
    card = not mail and not address and len(re.findall("[0-9xX*]", word)) >= 12 and set(letters) <= {"x"}
    phone = not mail and not address and few and 4 <= digits <= 15
    return mail | address << 1 | card << 2 | phone << 3


def patterns(text: str, start: int, end: int) -> list[str]:
    clean = lambda w: re.sub(r"[0-9]", "0", w.lower().strip(_EDGE))
    before = [w for w in map(clean, text[max(0, start - REACH) : start].split()) if w][-2:]
    behind = [w for w in map(clean, text[end : end + REACH].split()) if w][:1]
    out = []
    if before:
        out.append(f"{before[-1]} _")
        if len(before) == 2:
            out.append(f"{before[0]} {before[1]} _")
        if behind:
            out.append(f"{before[-1]} _ {behind[0]}")
    if behind:
        out.append(f"_ {behind[0]}")
    return out


_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rank", pa.int32()), ("may", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
SCAN = "doc_id long, base array<struct<start:int,rank:int,end:int>>, mentions array<struct<start:int,end:int,rank:int,may:int,value:string,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and mentions (rank -1: no seed) of every text."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, mentions = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                bases.append([{"start": s, "rank": r, "end": e} for s, r, e in base])
                spots = [(s, e, r) for s, r, e in base]
                if base or _SPECIAL.search(text):
                    spots += [(s, e, -1) for s, e in other_mentions(text, base)]
                mentions.append([{"start": s, "end": e, "rank": r, "may": possible_kinds(text[s:e]) | (1 << r if r >= 0 else 0), "value": text[s:e].lower(), "patterns": patterns(text, s, e)} for s, e, r in spots])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))], names=["doc_id", "base", "mentions"])

    return id_and_text(docs).mapInArrow(look, SCAN)


def pattern_graph(scanned: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """pattern, instance (hashes), rank (its kind as a seed, else -1), may: a row each, of patterns with enough instances."""
    spread = scanned.select(F.inline("mentions")).select(F.xxhash64("value").alias("instance"), "rank", "may", F.explode("patterns").alias("p"))
    graph = checkpointed(spread.groupBy(F.xxhash64("p").alias("pattern"), "instance").agg(F.max("rank").alias("rank"), F.min("may").alias("may")))
    enough = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= seeds).select("pattern")
    graph = graph.join(enough, "pattern")
    one = graph.groupBy("instance").agg(F.max("rank").alias("of"), F.min("may").alias("form"))
    return checkpointed(graph.join(one, "instance").select("pattern", "instance", F.col("of").alias("rank"), F.col("form").alias("may")))


def scored_patterns(graph: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """pattern, n0.. (seeds by kind), c0.. (confidence by kind) of the patterns with enough seeds of a kind."""
    kinds = range(len(KINDS))
    is_seed = [(F.col("rank") == k).cast("double") for k in kinds]
    seeded = graph.groupBy("pattern").agg(*[F.sum(x).alias(f"n{k}") for k, x in enumerate(is_seed)]).where(F.greatest(*[F.col(f"n{k}") for k in kinds]) >= seeds)
    graph = checkpointed(graph.join(seeded, "pattern"))
    if graph.isEmpty():
        return graph.select("pattern", *[F.col(f"n{k}") for k in kinds], *[F.lit(0.0).alias(f"c{k}") for k in kinds])
    scores = graph.select("instance", *[x.alias(f"s{k}") for k, x in enumerate(is_seed)]).distinct()
    before = None
    for turn in range(1, TURNS + 1):
        beliefs = graph.join(scores, "instance").groupBy("pattern").agg(*[F.avg(f"s{k}").alias(f"c{k}") for k in kinds], *[F.max(f"n{k}").alias(f"n{k}") for k in kinds])
        beliefs = checkpointed(beliefs)
        if turn % LOOK == 0:
            now = beliefs.join(before.select(F.col("pattern"), *[F.col(f"c{k}").alias(f"b{k}") for k in kinds]), "pattern")
            moved = now.agg(F.max(F.greatest(*[F.abs(F.col(f"c{k}") - F.col(f"b{k}")) for k in kinds]))).first()[0]
            if moved is None or moved < TOLERANCE:
                return beliefs
        before = beliefs
        score = [F.when(F.col("rank") >= 0, x).when(F.col("may").bitwiseAND(1 << k) != 0, DAMPING * F.avg(f"c{k}")).otherwise(0.0).alias(f"s{k}") for k, x in enumerate(is_seed)]
        scores = graph.join(beliefs.drop(*[f"n{k}" for k in kinds]), "pattern").groupBy("instance", "rank", "may").agg(*score).drop("rank", "may")
    raise RuntimeError(f"confidences still move after {TURNS} turns")


def trusted_patterns(scanned: DataFrame, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern (hash), rank, confidence of the patterns that may mark mentions."""
    kinds = range(len(KINDS))
    graph = pattern_graph(scanned, seeds)
    best = F.array_max(F.array(*[F.struct(F.when(F.col(f"n{k}") >= seeds, F.col(f"c{k}")).otherwise(0.0).alias("confidence"), F.lit(-k).alias("k")) for k in kinds]))
    for _ in range(GENERATIONS):
        beliefs = scored_patterns(graph, seeds)
        trusted = checkpointed(
            beliefs.select("pattern", best.alias("best")).where(F.col("best.confidence") >= confidence).select("pattern", (-F.col("best.k")).alias("kind"), F.col("best.confidence").alias("confidence"))
        )
        marked = graph.where("rank < 0").join(trusted, "pattern").where("(shiftright(may, kind) & 1) = 1")
        found = checkpointed(marked.groupBy("instance").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("found")))
        if found.isEmpty():
            return trusted.withColumnRenamed("kind", "rank")
        graph = checkpointed(graph.join(found, "instance", "left").withColumn("rank", F.coalesce("found", "rank")).drop("found"))
    raise RuntimeError(f"something new is still found after {GENERATIONS} generations")


NOTHING = "cast(array() as array<struct<start:int,rank:int,end:int>>)"


def with_found(rows: DataFrame, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """rows (of ``scan``, with a number row, checkpointed) and added, the spans of mentions in trusted patterns."""
    trusted = checkpointed(trusted_patterns(rows, seeds, confidence))
    some = trusted.limit(SMALL + 1).count()
    if not some:
        return rows.withColumn("added", F.expr(NOTHING))
    known = F.broadcast(trusted) if some <= SMALL else trusted
    open_ = rows.select("row", F.inline(F.filter("mentions", lambda m: m["rank"] < 0))).drop("rank")
    added = (
        open_.select("row", "start", "end", "may", F.explode("patterns").alias("p"))
        .select("row", "start", "end", "may", F.xxhash64("p").alias("pattern"))
        .join(known, "pattern")
        .where("(shiftright(may, rank) & 1) = 1")
        .groupBy("row", "start", "end")
        .agg(F.max_by("rank", F.struct("confidence", -F.col("rank"))).alias("rank"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    )
    return rows.join(added, "row", "left").withColumn("added", F.coalesce("added", F.expr(NOTHING)))


def find_private_data(docs: DataFrame, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context."""
    rows = with_found(checkpointed(scan(docs).withColumn("row", F.monotonically_increasing_id())), seeds, confidence)
    named = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"))
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(spans_text(named(F.col("base"))), 256).alias("base_sha256"),
        spans_text(named(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_context"),
    )


def held_out_recall(docs: DataFrame, folds: int = 5, seeds: int = SEEDS, confidence: float = CONFIDENCE) -> tuple[int, int, int]:
    """How many seeds are hidden (those of a fold of the values), found again by their contexts, and of these under the right kind."""
    hidden = lambda m: (m["rank"] >= 0) & (F.pmod(F.xxhash64(m["value"]), F.lit(folds)) == 0)
    bare = lambda m: F.struct(*[(F.when(hidden(m), -1).otherwise(m["rank"]) if c == "rank" else m[c]).alias(c) for c in ("start", "end", "rank", "may", "value", "patterns")])
    rows = checkpointed(scan(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("gone", F.filter("mentions", hidden)).withColumn("mentions", F.transform("mentions", bare)))
    found = with_found(rows, seeds, confidence)
    again = F.filter("gone", lambda m: F.exists("added", lambda s: (s["start"] == m["start"]) & (s["end"] == m["end"])))
    right = F.filter("gone", lambda m: F.exists("added", lambda s: (s["start"] == m["start"]) & (s["end"] == m["end"]) & (s["rank"] == m["rank"])))
    return tuple(int(x or 0) for x in found.agg(F.sum(F.size("gone")), F.sum(F.size(again)), F.sum(F.size(right))).first())
