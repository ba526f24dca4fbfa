import random
import re

import numpy as np
import pytest
import xxhash

from matchloom.llm import filters
from matchloom.llm import simhash_dedup as s
from matchloom.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(rows, key=lambda r: r[1]):
    """Smallest id reachable, over links of 4 and fewer bits."""
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (key(rows[i]) ^ key(rows[j])).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(rows))]


def corpus():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + len(rows), " ".join(copy)))
    return rows


def test_fingerprints(odd):
    texts = [t or "" for _, t in odd] + ["A B", "ÀB c d e f", "a\x85b c\x1cd e f g", "a\rb\x0bc\x0cd e"]
    assert [s.fingerprint(t) for t in texts] == [slow(t) for t in texts]


def test_brute_force(table, odd):
    rows = odd + corpus()
    got = s.near_duplicates(table(rows)).collect()
    prints = [(i, slow(t or "")) for i, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(prints, classes(prints), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize(("cell", "groups", "deep"), [(3, 5, s.DEEP), (2048, 6, s.DEEP), (2048, 8, s.DEEP), (3, 5, 6), (2048, 6, 10)])
def test_links_of_dense_and_crowded_cells(spark, cell, groups, deep):
    """Clouds of fingerprints around a few centres; small cells are dealt into blocks."""
    rng = random.Random(cell)
    points = {0, (1 << 64) - 1}
    for _ in range(10):
        centre = rng.getrandbits(64)
        for _ in range(25):
            points.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    edges = s.link_edges(spark.createDataFrame([(p,) for p in signed], "fp long"), cell, groups, deep)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    want = classes([(p, q) for p, q in zip(signed, points, strict=True)])
    assert [found.get(p, p) for p in signed] == want
    assert edges.count() < 71 * len(points)


def test_distance_bounds():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, (2, 1000), dtype=np.uint64)
    lower = np.bitwise_count(s.popcounts(a) ^ s.popcounts(b))
    assert (lower <= np.bitwise_count(a ^ b)).all()
    counts = lambda x: np.array([[(int(v) >> k & 1) + (int(v) >> k + 1 & 1) for k in range(0, 64, 2)] for v in x])
    assert (lower == np.abs(counts(a) - counts(b)).sum(axis=1)).all()
    for g in range(5, 11):
        assert sum(s.group_masks(g)) == (1 << 64) - 1 and len(s.group_masks(g)) == g
    assert [s.groups_for(n) for n in (0, 10**5, 10**7, 10**10)] == [5, 5, 6, 9]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 100)] + [(200, 200 + k) for k in range(1, 50)] + [(300, 300), (301, 302), (302, 301)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(101)}, **{k: 200 for k in range(200, 250)}, 301: 301, 302: 301}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_filter_keeps_one_of_each_class(table):
    rows = corpus()
    docs = table(rows)
    kept = filters.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = [(i, slow(t)) for i, t in rows]
    assert {r.doc_id for r in kept.collect()} == set(classes(prints))


def test_empty(table):
    assert s.near_duplicates(table([])).collect() == []
