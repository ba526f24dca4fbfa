import hashlib
import random
import re
import zlib
from itertools import groupby, product

import pytest

from matchloom.llm import conversations as C

SCHEMA = "symbol string, text string, role string, copy string, turn long, conv_id long, digest int, fault int, nth int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
GOAL = re.compile(r"(s?(ua)+)?")


def costs_of(symbols, audit):
    """Whether an audit repairs the rows, and its cost, by what each letter does; roles made stand as '?'."""
    cost, out, rows = 0, "", iter(symbols)
    for letter in audit:
        if letter == "I":
            cost, out = cost + 2, out + "?"
            continue
        s = next(rows)
        if letter == "D":
            cost += 3
            continue
        if s == "x":
            return None
        cost += (s in "SUA_") + (2 if letter == "R" else 0)
        out += "?" if letter == "R" else {"_": "-"}.get(s, s.lower())
    for roles in ["".join(p) for p in product("ua", repeat=out.count("?"))]:
        made = iter(roles)
        if GOAL.fullmatch("".join(next(made) if c == "?" else c for c in out)):
            return cost
    return None


def all_audits(n):
    for rows in product("DKR", repeat=n):
        for gaps in product(range(3), repeat=n + 1):
            yield "".join("I" * g + r for g, r in zip(gaps, rows, strict=False)) + "I" * gaps[n]


def slow_cheapest(symbols):
    """Dynamic programming over all edits, without a heuristic: the least (cost, audit) by state."""
    n = len(symbols)
    best = {0: (0, "")}
    for i in range(n + 1):
        for _ in range(4):  # insertions
            for q, (cost, audit) in list(best.items()):
                to = 3 if q == 2 else 2
                best[to] = min(best.get(to, (1 << 60, "")), (cost + 2, audit + "I"))
        if i == n:
            return min(v for q, v in best.items() if q in (0, 3))
        s, now = symbols[i], {}
        for q, (cost, audit) in best.items():
            edges = [(3, "D", q)]
            if s != "x":
                late = s in "SUA_"
                edges.append((2 + late, "R", 3 if q == 2 else 2))
                for initial, frm, to in (("s", (0,), 1), ("u", (0, 1, 3), 2), ("a", (2,), 3)):
                    if s.lower() == initial and q in frm:
                        edges.append((late, "K", to))
            for add, letter, to in edges:
                now[to] = min(now.get(to, (1 << 60, "")), (cost + add, audit + letter))
        best = now


def test_against_all_edit_sequences():
    audits = {n: list(all_audits(n)) for n in range(4)}
    rng = random.Random(1)
    for _ in range(120):
        symbols = "".join(rng.choices("suaSUA-_x", k=rng.randrange(4)))
        want = min((c, a) for a in audits[len(symbols)] if (c := costs_of(symbols, a)) is not None)
        assert C.cheapest(symbols) == want == slow_cheapest(symbols), symbols


def test_against_dynamic_programming_also_in_segments():
    rng = random.Random(2)
    for k in range(1500):
        letters = rng.choice(["suaSUA-_x", "ua", "uaUA", "uax", "uuua", "suax-"])
        symbols = "".join(rng.choices(letters, k=rng.randrange(40)))
        want = slow_cheapest(symbols)
        assert C.cheapest(symbols) == want, symbols
        assert C.cheapest(symbols, segment=rng.randrange(1, 9)) == want, symbols


def test_long_conversation_takes_near_linear_time():
    import time

    rng = random.Random(3)
    symbols = "".join(rng.choices("uaUAx-", k=40_000))
    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        cost, audit = C.cheapest(symbols[:n])
        took.append(time.process_time() - began)
        assert costs_sum(symbols[:n], audit) == cost
    assert took[1] < 9 * took[0]


def costs_sum(symbols, audit):
    rows = iter(symbols)
    return sum(2 if x == "I" else 3 if (s := next(rows), x)[1] == "D" else (s in "SUA_") + 2 * (x == "R") for x in audit)


def brute(rows):
    """The contract in plain Python: rows of (conv_id, turn, role, text)."""
    out = []
    sp = lambda x: " " if x is None else x
    for conv, members in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        now = []
        for _, turn, role, text in members:
            role, text = sp(role), sp(text)
            fault = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            role = "user" if fault == 4 else role
            now += [(turn, role, text)] * (2 if fault == 3 else 1)
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        now.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in now:
            last = BLANK.findall(text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            s = role[:1] if role[:1] in ("s", "u", "a") else "-"
            symbols += "x" if fault in ("blank", "duplicate") else ("_" if s == "-" else s.upper()) if fault else s
        cost, audit = slow_cheapest(symbols)
        turns = [t for t, _, _ in now if t is not None]
        initials = [r[:1] for _, r, _ in now]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        done, source = [], iter(now)
        for letter in audit:
            made = "assistant" if done and done[-1][0][:1] == "u" else "user"
            if letter == "I":
                done.append((made, ""))
                continue
            _, role, text = next(source)
            if letter != "D":
                done.append((role if letter == "K" else made, text))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit, sha))
    return sorted(out, key=str)


@pytest.fixture
def talk(spark):
    return lambda rows: spark.createDataFrame([("x", t, r, "y", n, c, 1, 2, 3) for c, n, r, t in rows], SCHEMA)


ODD = (
    [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", None), (1, None, "assistant", "Yes."), (1, 5, "", "No."), (1, 5, "", "No."), (1, 9, "user", " \t\x0b ")]
    + [(2, t, "user" if t % 2 else "assistant", "Same.") for t in range(60)]
    + [(3, t, r, f"Row {t} ") for t, r in enumerate(["system", "user", "agent", "System", "assistant", "sys", "user"])]
    + [(4, 1, "user", "word " * 40_000 + ".\n\n"), (4, 1, "user", "word " * 40_000 + ".\n\n"), (4, 2, "assistant", "é 😀!\r\n")]
    + [(5, -(1 << 63), "user", "a."), (5, (1 << 63) - 1, "assistant", "b.")]
)


def test_odd_rows(talk):
    got = sorted(map(tuple, C.repairs(C.damaged(talk(ODD))).collect()), key=str)
    want = [(*w[:1], min(w[1], (1 << 63) - 1), *w[2:]) for w in brute(ODD)]
    assert got == want


def test_a_conversation_whose_rows_are_all_dropped(talk):
    gone = [t for t in range(400) if zlib.crc32(f"7:{t}".encode()) % 20 == 0]
    got = [tuple(r) for r in C.repairs(C.damaged(talk([(7, t, "user", "A.") for t in gone]))).collect()]
    assert got == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_missing_rows_are_seen_by_none(talk):
    """A dropped row is no earlier copy of a later one."""
    at = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0 and zlib.crc32(f"8:{t + 1}".encode()) % 20 > 4)
    rows = [(8, at, "user", "A."), (8, at + 1, "user", "A.")]
    assert [r.duplicate for r in C.repairs(C.damaged(talk(rows))).collect()] == [0]


def test_repaired_turns_make_the_digest(talk):
    rows = [(c, t, random.Random(c * 99 + t).choice(["user", "assistant", "system"]), f"Text {t % 7}" + ".!x"[t % 3]) for c in range(30) for t in range(c)]
    marked = C.damaged(talk(rows))
    lines: dict = {}
    for r in C.repaired_turns(marked).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(lines[r.conv_id]) - 1
    for r in C.repairs(marked).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest()
    plain = C.as_rows(talk([(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")]))
    assert [(r.cost, r.audit) for r in C.repairs(plain).collect()] == [(0, "KK")]


def test_hot_conversation_and_hot_text(talk):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), "Same." if t % 3 else f"Own {t}.") for t in range(4000)] + [(c, 0, "user", "Same.") for c in range(2, 300)]
    assert sorted(map(tuple, C.repairs(C.damaged(talk(rows))).collect()), key=str) == brute(rows)


def test_empty_table(talk):
    assert C.repairs(C.damaged(talk([]))).collect() == []
    assert C.repaired_turns(C.damaged(talk([]))).collect() == []


def test_given_table(spark, sf):
    from matchloom.llm.queries import op13_conversations

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted(map(tuple, op13_conversations(spark, sf).collect()), key=str) == brute(rows)
