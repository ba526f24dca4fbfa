"""Conversation structure repair by A* on the lattice of edits.

A conversation's rows, by turn, become symbols: the role's initial and the row's fault. A node of the lattice is
(rows read, state), the state being what the repaired roles so far allow next: nothing yet, behind a system row,
behind a user, behind an assistant. Edits are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert of
an empty user or assistant row (2); a truncated row that stays costs 1. The heuristic is the suffix sum of what no
repair avoids: 3 for every blank or duplicate row ahead and 1 for every truncated one. The queue is ordered by
(cost plus heuristic, audit), so the first path to a node is the cheapest one and of these the least as text. In each
state at most one role can be inserted or assigned, so an audit tells the repaired rows.

Scale: symbols are a byte a row. Long conversations are searched in segments of SEGMENT rows, from each state, and
the segments are joined from the last to the first: an insertion belongs to the row behind it, so of two paths of
a segment neither audit begins with the other and the segment alone decides between ties. Duplicates are found by
carried counts (operators.ranges), so one text in a third of the rows fills many tasks. Texts travel once, sorted,
and are hashed or handed on as they pass; a task holds one batch, one audit and four bytes a row of one
conversation. That an audit is one value, and the digest one chain, leaves a conversation's last pass to one task.

Defined results: null role or text is one space, also where the damage reads conv_id and turn; a null conv_id is a
conversation; rows of one turn, and those without turn, stand in the order of their digests, copies adjacent; an
empty role counts as one of no known initial; very long texts go whole; repeated rows are duplicates; a conversation
without rows has zeros, an empty audit and the digest of nothing; gaps beyond a long are cut to the largest;
an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import numbered

RATE = 20
SEGMENT = 512
#: Plans of sequences up to SHORT rows that a task remembers.
REMEMBERED, SHORT = 100_000, 32
RULED_OUT = "x"
#: The state behind a row of that initial, for the states that allow it: 0 nothing yet, 1 system, 2 user, 3 assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The only role that can be inserted or assigned in a state, and the state behind it.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Cost and audit of closing a conversation in a state.
CLOSING = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def as_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy (0; -1 marks a conversation whose row is missing, 1 a repeated row)."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.lit(0).alias("copy"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with known damage, by crc32 of conv_id:turn."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = as_rows(conversations).withColumn("fault", F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % RATE)
    fault = F.col("fault")
    text = F.when(fault <= 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(fault == 0, F.array(F.lit(-1))).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _symbol(nth: Column) -> Column:
    """s, u, a or -, in upper case (-: _) for a truncated row; B or D for a blank or duplicate one; nothing for a missing row."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    cut = F.when(known == "-", "_").otherwise(F.upper(known))
    return F.when(F.col("copy") < 0, "").when(F.col("end") == "", "B").when(nth > 1, "D").when(F.col("end").isin(".", "!", "?"), known).otherwise(cut)


def plans(rows: DataFrame) -> DataFrame:
    """The counts of faults and the cheapest edits of each conversation."""
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    digest = F.when(F.col("copy") >= 0, F.col("digest")).alias("digest")  # missing rows have been seen by none
    slim = _with_digest(rows).select("conv_id", "turn", "copy", digest, F.substring("role", 1, 1).alias("initial"), F.right(trimmed, F.lit(1)).alias("end"))
    symbols = numbered(slim, ["conv_id", "digest"], ["turn", "copy"]).withColumn("symbol", _symbol(F.col("nth")))
    dealt = symbols.select("conv_id", "turn", "digest", "copy", "initial", "symbol").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", "copy")
    return dealt.select("conv_id", "turn", "initial", "symbol").mapInArrow(_plan, PLAN)


def repairs(rows: DataFrame) -> DataFrame:
    """The plans with repaired_sha256, the digest of the repaired rows as role:text lines."""
    return _in_order(rows, plans(rows)).mapInArrow(_digests, f"{PLAN}, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the repaired rows."""
    return _in_order(rows, plans(rows)).mapInArrow(_turns, "conv_id long, place long, role string, text string")


def _in_order(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan with its rows behind it."""
    facts = [f.split()[0] for f in PLAN.split(", ")][1:]
    lead = planned.withColumn("row", F.lit(False))
    both = lead.unionByName(_with_digest(rows.where("copy >= 0")).withColumn("row", F.lit(True)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "digest", "copy").select("conv_id", "row", "role", "text", *facts)


def search(symbols: str, state: int, last: bool) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from a state over all rows to each state that can be reached; if last, to the end alone, as state -1."""
    n = len(symbols)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if symbols[i] == RULED_OUT else TRUNCATED if symbols[i] in "SUA_" else 0)
    queue: list[tuple[int, str, int, int]] = [(ahead[0], "", 0, state)]
    closed: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while queue:
        total, audit, i, q = heapq.heappop(queue)
        if (i, q) in closed:
            continue
        closed.add((i, q))
        if q < 0 or (i == n and not last):
            found[q] = (total, audit)
            if last:
                break
            continue
        if i == n:
            cost, letters = CLOSING[q]
            heapq.heappush(queue, (total + cost, audit + letters, n, -1))
            continue
        cost, symbol = total - ahead[i], symbols[i]
        heapq.heappush(queue, (cost + DELETE + ahead[i + 1], audit + "D", i + 1, q))
        behind = NEXT[q][1]
        heapq.heappush(queue, (total + INSERT, audit + "I", i, behind))
        if symbol != RULED_OUT:
            stays = cost + (TRUNCATED if symbol in "SUA_" else 0) + ahead[i + 1]
            kept = STEPS.get((q, symbol.lower()))
            if kept is not None:
                heapq.heappush(queue, (stays, audit + "K", i + 1, kept))
            if kept != behind:
                heapq.heappush(queue, (stays + REROLE, audit + "R", i + 1, behind))
    return found


def cheapest(symbols: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, of those the least as text."""
    if len(symbols) <= segment:
        return search(symbols, 0, True)[-1]
    rest = dict(CLOSING)  # state -> (cost, trailing audit) of the segments behind; audits of segments are chained by state
    chain: list[dict[int, tuple[str, int]]] = []
    for at in range((len(symbols) - 1) // segment * segment, -1, -segment):
        ahead, links = {}, {}
        for state in range(4) if at else (0,):
            ends = search(symbols[at : at + segment], state, False)
            cost, audit, end = min((cost + rest[end][0], audit, end) for end, (cost, audit) in ends.items())
            ahead[state], links[state] = (cost, ""), (audit, end)
        rest = ahead
        chain.append(links)
    state, pieces = 0, []
    for links in reversed(chain):
        audit, state = links[state]
        pieces.append(audit)
    return rest[0][0], "".join(pieces) + CLOSING[state][1]


class _Conversation:
    def __init__(self, key: int | None):
        self.key, self.symbols = key, []
        self.least: int | None = None
        self.turn: int | None = None
        self.distinct = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, initial: str, symbol: str) -> None:
        if not symbol:
            return
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.turn, self.distinct = turn, self.distinct + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.symbols.append(symbol)


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory: dict[str, tuple[int, str]] = {}
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in PLAN.split(", ")])
    out: list[tuple] = []
    size = 0

    def close(c: _Conversation) -> None:
        nonlocal size
        text = "".join(c.symbols)
        key = text.replace("B", RULED_OUT).replace("D", RULED_OUT)
        found = memory.get(key)
        if found is None:
            found = cheapest(key)
            if len(key) <= SHORT and len(memory) < REMEMBERED:
                memory[key] = found
        cost, audit = found
        gaps = 0 if c.least is None else min(c.turn - c.least + 1 - c.distinct, (1 << 63) - 1)
        out.append((c.key, gaps, text.count("B"), text.count("D"), sum(map(text.count, "SUA_")), c.illegal, cost, audit))
        size += len(audit) + 64

    current: _Conversation | None = None
    for batch in batches:
        for key, turn, initial, symbol in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if current is None or key != current.key:
                if current is not None:
                    close(current)
                current = _Conversation(key)
            current.add(turn, initial, symbol)
        if size > 1 << 20:
            yield _batch(out, schema)
            out, size = [], 0
    if current is not None:
        close(current)
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _Walk:
    """The repaired rows of one conversation, as its rows pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _made(self) -> str:
        role, self.state = NEXT[self.state]
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = STEPS[(self.state, role[:1])]
            yield role, text
        elif letter == "R":
            yield self._made(), text


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, str, str]]:
    """(plan, "", "") where a conversation begins, (None, role, text) for its repaired rows."""
    walk: _Walk | None = None
    for batch in batches:
        keys, is_row, roles, texts = (batch.column(k).to_pylist() for k in range(4))
        for k, row in enumerate(is_row):
            if row:
                for role, text in walk.row(roles[k], texts[k]):
                    yield None, role, text
                continue
            if walk is not None:
                for role, text in walk.inserted():
                    yield None, role, text
            plan = (keys[k], *(batch.column(c)[k].as_py() for c in range(4, batch.num_columns)))
            walk = _Walk(plan[-1])
            yield plan, "", ""
    if walk is not None:
        for role, text in walk.inserted():
            yield None, role, text


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in f"{PLAN}, repaired_sha256 string".split(", ")])
    out: list[tuple] = []
    size, plan, chain, between = 0, None, None, b""
    for begins, role, text in _walked(batches):
        if begins is None:
            chain.update(between + f"{role}:{text}".encode())
            between = b"\n"
            continue
        if plan is not None:
            out.append((*plan, chain.hexdigest()))
            size += len(plan[-1]) + 128
        plan, chain, between = begins, hashlib.sha256(), b""
        if size > 1 << 20:
            yield _batch(out, schema)
            out, size = [], 0
    if plan is not None:
        out.append((*plan, chain.hexdigest()))
    if out:
        yield _batch(out, schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out: list[tuple] = []
    size, key, place = 0, None, 0
    for begins, role, text in _walked(batches):
        if begins is not None:
            key, place = begins[0], 0
            continue
        out.append((key, place, role, text))
        place, size = place + 1, size + len(text) + 32
        if size > 1 << 20:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)
