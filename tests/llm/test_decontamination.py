import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchloom.llm import decontamination as d
from matchloom.llm import filters

ITEM = "If Anna has 3 apples and Bob gives Anna 4 kg of apples, how many apples does Anna carry home?"
NEW = "If Otto has 7 apples and Mia gives Otto 9 kg of apples, how many apples does Otto carry home?"


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 5, 1.0) for i, t in rows], "item_id long, text string, windows int, coverage double")


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) for _ in range(n))


def brute(docs, items):
    """Share of an item's distinct 5-word windows in a document; for plain lower-case words without placeholders."""
    found = set()
    for i, t in docs:
        w = (t or "").replace(".", " ").split()
        have = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for j, b in items:
            x = b.replace(".", " ").split()
            want = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
            if want and len(want & have) >= 0.8 * len(want):
                found.add((i, j))
    return found


def test_brute_force(spark, table):
    rng = random.Random(2)
    items = [(j, words(rng, rng.randint(12, 40))) for j in range(30)]
    docs = []
    for i in range(120):
        item = rng.choice(items)[1].split()
        keep = item[rng.randint(0, 4) : len(item) - rng.randint(0, 4)] if i % 3 else []
        docs.append((i, f"{words(rng, rng.randint(0, 60))}. {' '.join(keep)}. {words(rng, 20)}"))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(table(docs), bench(spark, items)).collect()}
    assert got == brute(docs, items) and len(got) > 20


def test_new_parameters_are_caught_and_inconsistent_ones_not(spark, table):
    items = bench(spark, [(1, ITEM), (2, "Hi there you"), (3, None), (4, ""), (5, ITEM)])
    docs = [
        (1, f"Noise before. {NEW} Noise after that."), (2, "If Otto has 7 apples and Mia gives Ann 9 kg of apples, how many apples does Kim carry home? " * 1),
        (3, "hi there you"), (4, None), (5, "so hi there you all"), (None, ITEM), (7, ITEM), (7, ITEM), (8, "We had apples at home and many more."),
    ]
    got = {(r.doc_id, r.item_id): r for r in d.contaminated(table(docs), items).collect()}
    assert {(1, 1), (1, 5), (3, 2), (None, 1), (7, 1)} <= set(got)
    assert got[1, 1].coverage == 1.0 and got[1, 1].consistency == 1.0
    assert not any(i in (4, 5, 8) for i, _ in got)
    assert (2, 1) not in got or got[2, 1].consistency < 1


def test_large_benchmark_joins_by_shuffle(spark, table, monkeypatch):
    docs, items = table([(1, NEW), (2, "nothing here at all to be found")]), bench(spark, [(1, ITEM)])
    one = d.contaminated(docs, items).collect()
    monkeypatch.setattr(d, "SMALL", 0)
    assert d.contaminated(docs, items).collect() == one and len(one) == 1


def test_filter(spark, table, odd):
    docs = table(odd + [(90, "x. " + ITEM)])
    kept = filters.without_contaminated(docs, bench(spark, [(1, ITEM)]))
    assert kept.columns == docs.columns and kept.count() == len(odd)


def test_empty_sides(spark, table, odd):
    assert d.contaminated(table([]), bench(spark, [(1, ITEM)])).collect() == []
    assert d.contaminated(table(odd), bench(spark, [])).collect() == []


def test_names_that_open_sentences_are_slots(spark, table):
    item = "On Monday Tom has 5 apples and walks to the market near the river. Anna buys half of these apples from him. Tom eats two apples and carries the others home again."
    new = item.replace("Tom", "Otto").replace("Anna", "Mia").replace("5", "8")
    got = {(r.doc_id, r.item_id): r for r in d.contaminated(table([(1, f"Some noise. {new} And noise."), (2, item), (3, "Anna eats. " * 9)]), bench(spark, [(1, item)])).collect()}
    assert {(1, 1), (2, 1)} <= set(got) and (3, 1) not in got
    assert got[1, 1].coverage == got[1, 1].consistency == got[2, 1].coverage == 1.0


def test_slots_are_judged_by_occurrence(spark, table):
    parts = ["today we {}", "and old {}", "met young {}", "near tall {}", "by wide {}", "beside shy {}"]
    item = " ".join(parts).format("Anna", "Bob", "Cleo", "Dora", "Emil", "Finn")
    rng = random.Random(5)
    names = [f"{a}{b}" for a in "KLMNPRST" for b in ("al", "en", "ir", "od", "us")]
    docs = [(k, f"{item}. Then this: {' '.join(parts).format(*rng.sample(names, 6))}. End") for k in range(12)]
    again = [(100 + k // 2, item if k % 2 else " ".join(parts).format(*rng.sample(names, 6))) for k in range(24)]
    inserted = [(200, item.replace("near", "near very") + ". " + " ".join(parts).format(*names[:6]))]
    got = {(r.doc_id, r.item_id): r for r in d.contaminated(table(docs + again + inserted), bench(spark, [(1, item)])).collect()}
    for i in [*range(12), *range(100, 112), 200]:
        assert got[i, 1].coverage == got[i, 1].consistency == 1.0, i


def test_inconsistent_slots_stay_out(spark, table):
    item = "when Anna met him Anna gave him flowers but Anna kept one rose because Anna liked red roses"
    other = item
    for name in ("Kim", "Lea", "Mia", "Noa"):
        other = other.replace("Anna", name, 1)
    assert {r.doc_id for r in d.contaminated(table([(1, other), (2, item.replace("Anna", "Kim"))]), bench(spark, [(1, item)])).collect()} == {2}


def test_copies_in_other_case_are_found(spark, table):
    item = "Once Anna Bell met Carl on the road to Ulm and sold Carl 3 hens for 12 dollars, and Anna spent it all on bread and milk."
    docs = [(1, item.lower()), (2, item.upper()), (3, f"some words. {item.title()}"), (4, item.replace("Anna", "Mia").lower()), (5, item.replace("Carl", "Otto"))]
    got = {r.doc_id: r for r in d.contaminated(table(docs), bench(spark, [(1, item)])).collect()}
    assert set(got) >= {1, 2, 3, 5} and got[1].coverage == got[2].coverage == 1.0


def test_a_template_that_most_rows_and_items_share(spark, table):
    rng = random.Random(11)
    stock = "as we have said in the last part of this long report on the state of the land"
    items = [(k, f"{stock} {words(rng, 30)}") for k in range(60)]
    docs = [(k, f"{stock} {words(rng, 10)}") for k in range(180)] + [(500 + k, items[k][1]) for k in range(20)] + [(None, items[0][1])] * 50
    first = d.rarest(spark.createDataFrame([(b"a", 1), (b"a", 2), (b"a", 3), (b"a", 4), (b"b", 1), (b"b", 2), (b"b", 5)], "item binary, item_window long"), spark.createDataFrame([(b"a", 4), (b"b", 3)], "item binary, windows long"), 0.8)
    assert sorted((bytes(r.item), r.item_window) for r in first.collect()) == [(b"a", 3), (b"b", 5)]
    got = {(r.doc_id, r.item_id) for r in d.contaminated(table(docs), bench(spark, items)).collect()}
    assert got == brute([x for x in docs if x[0] is not None], items) | {(None, 0)}


def test_long_words_differ_at_their_ends(spark, table):
    item = " ".join(["x" * 5000 + c for c in "abcdefgh"])
    docs = [(1, item), (2, " ".join(["x" * 5000 + c for c in "bacdefhg"])), (3, " ".join([c + "x" * 5000 for c in "abcdefgh"])), (4, " ".join(["x" * 4999 + c + "x" for c in "abcdefgh"]))]
    assert {r.doc_id for r in d.contaminated(table(docs), bench(spark, [(1, item)])).collect()} == {1}


def consistency(fillings: list[dict]) -> float:
    """Share of the slot fillings with the document's most frequent value for the item's."""
    values: dict[int, Counter] = defaultdict(Counter)
    for f in fillings:
        for k in range(d.WINDOW):
            if f["types"] >> 2 * k & 3:
                values[f["item_slots"][k]][f["slots"][k]] += 1
    total = sum(c.total() for c in values.values())
    return sum(max(c.values()) for c in values.values()) / total if total else 1.0


def slow_alignment(fillings: list[dict], windows: int, found: int, similarity: float) -> tuple[int, float] | None:
    """Every alignment over all occurrences, slot by slot."""
    if not any(f["types"] for f in fillings):
        return found, 1.0
    fillings = sorted(fillings, key=lambda f: (f["types"].bit_count(), f["types"], f["slots"] or [], f["item_slots"] or []))
    number = np.repeat(np.arange(len(fillings)), [len(f["shifts"]) for f in fillings])
    shift = np.concatenate([f["shifts"] for f in fillings]).astype(np.int64)
    window = np.unique([f["window"] for f in fillings], return_inverse=True)[1][number]
    alignments, support = np.unique(np.unique(np.stack((shift, window)), axis=1)[0], return_counts=True)
    best, seen = None, set()
    for k in np.argsort(-support, kind="stable"):
        far = np.abs(shift - alignments[k])
        order = np.lexsort((number, far, window))
        nearest = order[np.unique(window[order], return_index=True)[1]]
        for chosen in (nearest, nearest[far[nearest] <= windows // 2]):
            if len(chosen) / windows < similarity or (key := tuple(sorted(number[chosen]))) in seen:
                continue
            seen.add(key)
            share = consistency([fillings[i] for i in key])
            if share >= similarity and (best is None or (share, len(chosen)) > (best[1], best[0])):
                best = len(chosen), share
        if best == (found, 1.0):
            break
    return best


def scattered(rng, windows, occurrences, copies):
    """Fillings of an item whose copies, with own slot values, and stray windows stand in a document."""
    types = [rng.choice([0, 1, 1 | 2 << 2, 3 << 4]) for _ in range(windows)]
    item = [[rng.randrange(4) if types[w] >> 2 * k & 3 else 0 for k in range(d.WINDOW)] for w in range(windows)]
    met = defaultdict(set)
    places = [(w, at) for at in (rng.randrange(4000) for _ in range(copies)) for w in range(windows) if rng.random() < 0.95]
    places += [(rng.randrange(windows), rng.randrange(4000)) for _ in range(occurrences)]
    values = {}
    for w, at in places:
        said = tuple(values.setdefault((at, item[w][k]), rng.randrange(9)) if types[w] >> 2 * k & 3 and rng.random() < 0.97 else rng.randrange(9) for k in range(d.WINDOW))
        met[w, said if types[w] else None].add(at)
    return [{"window": w, "types": types[w], "slots": list(said) if said else None, "item_slots": item[w] if said else None, "shifts": sorted(at)} for (w, said), at in met.items()]


def test_alignments_are_those_of_the_slow_version():
    rng = random.Random(12)
    passed = 0
    for _ in range(400):
        windows = rng.randrange(1, 12)
        fillings = scattered(rng, windows, rng.randrange(0, 30), rng.randrange(0, 5))
        if not fillings:
            continue
        found = len({f["window"] for f in fillings})
        want = slow_alignment(fillings, windows, found, 0.8)
        got = d.best_alignment(fillings, windows, found, 0.8)
        assert (got is None) == (want is None) and (got is None or (got[0] == want[0] and got[1] == pytest.approx(want[1])))
        passed += got is not None
    assert passed > 50


def test_a_list_of_exercises_takes_near_linear_time():
    """One item again and again with random numbers; none of its copies agrees, so no early end."""
    took = {}
    for n in (1600, 3200, 12800):
        rng = random.Random(n)
        fillings = [
            {"window": w, "types": 1 | 1 << 4, "slots": [rng.randrange(10**6) for _ in range(5)], "item_slots": [1, 0, 2 + w % 2, 0, 0], "shifts": [at * 40]}
            for at in range(n) for w in range(26)
        ]
        began = time.process_time()
        d.best_alignment(fillings, 26, 26, 0.8)
        took[n] = time.process_time() - began
    assert took[3200] < 3 * took[1600] + 0.2 and took[12800] < 12 * took[1600] + 0.5
