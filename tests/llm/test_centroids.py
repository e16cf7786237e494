"""Clusters against plain rounds, bounds that never exceed a distance, odd rows."""

import hashlib
import math

import numpy as np

from subsight.llm import centroids as C


def brute(rows, k, rounds, dims):
    """rows: (vec_id, embedding) -> (vec_id, cluster, distance, centroid), sorted."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in e]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    means = [v for _, v in first]
    for last in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(means)) for _, v in kept]
        if last == rounds:
            break
        for j in range(len(means)):
            mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if mine:
                means[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted(((i, c, d, hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, near)), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0, 1.5) for r in rows], "vec_id long, embedding array<float>, cluster int, distance double")
    out = C.cluster(df, **kw).collect()
    if out:
        assert {r["inertia"] for r in out} == {sum(r["distance"] for r in out)}
        for r in out:
            assert r["cluster_inertia"] == sum(o["distance"] for o in out if o["cluster"] == r["cluster"])
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in out), key=str)


def test_plain_rounds(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(5, 4)) * 3
    rows = [(i, (middles[i % 5] + rng.normal(size=4)).tolist()) for i in range(300)]
    for rounds in (0, 1, 10):
        assert run(spark, rows, k=6, rounds=rounds, dims=4) == brute(rows, 6, rounds, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [0.0, 0.0]),
            (8, [0.0, 0.0]), (8, [0.0, 0.0]), (9, [1.0, -1.0]), (None, [0.5, 0.5]), (11, [-0.0001, 0.0001]), (12, [1.0, -1.0])]
    assert run(spark, rows, k=8, rounds=10, dims=2) == brute(rows, 8, 10, 2)
    assert run(spark, rows, k=3, rounds=10, dims=2) == brute(rows, 3, 10, 2)
    # a component whose distances would not fit in 64 bits
    assert len(run(spark, [(1, [1e30, 0.0]), (2, [1.0, 1.0])], k=2, rounds=2, dims=2)) == 1


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []


def test_copies_and_ties(spark):
    # a third of all rows is one vector; (1, 0) lies between two centroids
    rows = [(i, [0.0, 0.0]) for i in range(40)] + [(100 + i, [2.0, 0.0]) for i in range(40)] + [(200 + i, [1.0, 0.0]) for i in range(40)]
    for k in (2, 5):
        assert run(spark, rows, k=k, rounds=3, dims=2) == brute(rows, k, 3, 2)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for size in (10, 10**5, C.LIMIT):
        x, c = (rng.integers(-size, size, (n, 64)) for n in (400, 8))
        x[:8] = c  # a vector that is a pivot
        x[8:16] = c + rng.integers(-1, 2, c.shape)
        for pivots in (c, c[:2], c[:1], np.concatenate((c, c))):
            low = C.pivot_bounds(C._to_pivots(x, pivots), C._to_pivots(c, pivots), pivots)
            true = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)) for m in c] for v in x], object)
            assert all(math.floor(b) <= t for b, t in zip(low.ravel().tolist(), true.ravel()))
            cluster, distance, checked = C.nearest(x, low, c)
            assert cluster.tolist() == [min(range(8), key=lambda j: (row[j], j)) for row in true]
            assert distance.tolist() == [min(row) for row in true]
            assert 1 <= checked.min() and checked.max() <= 8


def test_bounds_prune():
    # two far groups: near the pivots of one group, the centroids of the other are never checked
    rng = np.random.default_rng(3)
    c = np.concatenate((rng.integers(0, 50, (4, 8)), rng.integers(5000, 5050, (4, 8))))
    x = np.concatenate([m + rng.integers(-3, 4, (100, 8)) for m in c])
    low = C.pivot_bounds(C._to_pivots(x, c), C._to_pivots(c, c), c)
    assert C.nearest(x, low, c)[2].mean() < 2
