import hashlib
import math

import numpy as np
import pytest

from matchloom.llm import centroids

SCHEMA = "cluster int, embedding array<float>, vec_id long, distance string, ints int, block int"


def brute(rows, k, rounds, width, seed="3"):
    """Full scans in plain Python."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centers = [p for _, p in sorted((mark(i), p) for i, p in kept)[:k]]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    nearest = lambda p: min((far(p, c), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        of = [nearest(p)[1] for _, p in kept]
        for n in range(len(centers)):
            own = [p for (_, p), o in zip(kept, of, strict=True) if o == n]
            if own:
                centers[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *nearest(p)) for i, p in kept]
    total = {n: sum(d for _, d, o in last if o == n) for n in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted([(i, n, d, total[n], sum(total.values()), sha[n]) for i, d, n in last], key=str)


def run(spark, rows, parts=3, **options):
    table = spark.createDataFrame([(9, e, i, "x", 5, 7) for i, e in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, centroids.cluster(table, **options).collect()), key=str)


def blobs(n, width, middles, seed):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 1, (middles, width))
    return [(i, (at[rng.integers(middles)] + rng.normal(0, 0.3, width)).astype("float32").tolist()) for i in range(n)]


@pytest.mark.parametrize(("k", "groups", "rounds"), [(8, 3, 10), (12, 4, 6), (5, 1, 3), (3, 9, 0)])
def test_equals_full_scans(spark, k, groups, rounds):
    rows = blobs(400, 6, 9, k)
    assert run(spark, rows, k=k, groups=groups, rounds=rounds, width=6) == brute(rows, k, rounds, 6)


def test_odd_vectors_ties_and_repeated_rows(spark):
    """Coarse components make ties, also between centroids; repeated rows may be equal centroids, of which later ones stay empty."""
    rng = np.random.default_rng(2)
    rows = [(i % 40, (rng.integers(-2, 3, 4) / 1024).tolist()) for i in range(150)] + [(7, [0.0] * 4)] * 60
    rows += [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0, None, 0.0, 0.0]), (1004, [float("nan")] * 4), (1005, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, -0.5, 0.25, 0.0])]
    assert run(spark, rows, k=8, groups=3, rounds=5, width=4) == brute(rows, 8, 5, 4)


def test_few_or_no_vectors(spark):
    assert run(spark, [(1, [0.5, 0.5]), (2, [0.1, 0.1])], k=8, rounds=2, width=2) == brute([(1, [0.5, 0.5]), (2, [0.1, 0.1])], 8, 2, 2)
    assert run(spark, [], k=8, width=2) == []
    assert run(spark, [(1, None)], k=8, width=2) == []


def test_large_components(spark):
    rows = [(i, [x * 1000.0, -x * 7000.0]) for i, x in enumerate(range(-15, 16))]
    assert run(spark, rows, k=4, rounds=4, width=2) == brute(rows, 4, 4, 2)
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e9, 0.0])], k=1, width=2)


def test_bounds_save_distances():
    """After the first scan most vectors keep their centroid without a full scan, and the bounds hold."""
    x = np.array([p for _, p in blobs(2000, 16, 10, 5)])
    x = np.floor(1024 * x).astype("<i4")
    c = x[:20].astype(np.int64)
    move = centroids.Move(c, centroids.grouped(c, 4), np.zeros(20))
    bounds = move.started(x)
    spent = []
    for _ in range(8):
        new = np.array([x[bounds.of == k].sum(0, dtype=np.int64) // max(1, (bounds.of == k).sum()) if (bounds.of == k).any() else c[k] for k in range(20)])
        move = centroids.Move(new, move.group, np.sqrt(centroids.squared(new, c).astype(float)) * (1 + centroids.SLACK))
        c = new
        bounds, computed = move.followed(x, centroids.Bounds.unpack(bounds.pack(), len(x)))
        spent.append(computed)
        exact = np.sqrt(np.stack([centroids.squared(x, k) for k in c], axis=1).astype(float))
        assert (bounds.of == move.started(x).of).all()
        assert (bounds.upper >= exact[np.arange(len(x)), bounds.of] - 1e-6).all()
        exact[np.arange(len(x)), bounds.of] = np.inf
        for g in range(move.group.max() + 1):
            assert (bounds.lower[:, g] <= exact[:, move.group == g].min(1) + 1e-6).all()
    assert spent[-1] < 20 * len(x) / 4


def test_given_table(spark, sf):
    from matchloom.llm.queries import op11_centroids

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op11_centroids(spark, sf).collect()), key=str) == brute(rows, 8, 10, 64)
