"""Hard negatives against all scores, Strassen's products, heaps, odd rows."""

import math

import numpy as np
import pytest

from subsight.llm import negatives as H


def brute(rows, every=50):
    """rows: (vec_id, embedding, label) -> sorted result rows."""
    part = []
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            part.append((i, [math.floor(256 * float(np.float32(x))) for x in e], label))
    out = []
    for n, (a, va, la) in enumerate(part):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label == la) for m, (i, v, label) in enumerate(part) if m != n)
        for s, p, _ in [r for r in scored if r[2]][:5]:
            negatives = [(i, t) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, r, i, -s, -t) for r, (i, t) in enumerate(negatives[:3], 1)]
    return sorted(out)


def run(spark, rows, every=50):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row int, slot int")
    return sorted(tuple(r) for r in H.mine(df, every=every).collect())


def table(n, seed=0, labels=4, dims=6):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.normal(size=dims) * 0.3 + (0.2 if rng.random() < 0.5 else 0)).tolist(), int(rng.integers(labels))) for i in rng.permutation(n)]


def test_all_scores(spark):
    rows = table(400)
    assert run(spark, rows, 20) == brute(rows, 20) != []


def test_small_groups(spark, monkeypatch):
    # a label with a third of all rows, in blocks; heaps that merge between tiles and between groups
    for name, size in (("ANCHORS", 7), ("MEMBERS", 50), ("TILE_ANCHORS", 3), ("TILE_MEMBERS", 17)):
        monkeypatch.setattr(H, name, size)
    rows = [(i, e, 0 if i % 3 else label) for i, e, label in table(300, 5, 6)]
    assert run(spark, rows, 10) == brute(rows, 10) != []


def test_ties_and_copies(spark):
    rows = [(i, [0.5, 0.25], 1) for i in range(12)] + [(20 + i, [0.25, 0.25], 2) for i in range(9)] + [(0, [0.5, 0.25], 1)]
    assert run(spark, rows, 10) == brute(rows, 10) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.6, 0.5], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2),
            (6, [None, 1.0], 2), (7, [0.6, 0.4], None), (None, [0.6, 0.4], 2), (8, [], 2), (9, [0.7], 3), (50, [0.0, 0.0], 1),
            (11, [0.6, 0.4, 0.9], 3), (100, [-1.0, 0.0], 5), (101, [1.0, 0.0], 5)]
    assert run(spark, rows) == brute(rows) != []
    # a norm whose scores would not fit in 64 bits
    assert run(spark, [*rows, (12, [1e12, 0.0], 2), (150, [1e30, 0.0], 1)]) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []


def test_many_labels(spark):
    rows = [(i, e, i // 3) for i, e, _ in table(150, 9)]
    assert run(spark, rows, 10) == brute(rows, 10) != []


def test_relabelled(spark):
    df = spark.createDataFrame([(0, None, 9), (7, None, 2147483647), (1, None, 3), (14, None, None), (None, None, 4)], "vec_id long, embedding array<float>, label int")
    assert [r["label"] for r in H.relabelled(df).collect()] == [0, 8, 3, None, 4]


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 17, 40), (64, 64, 64), (5, 64, 70), (130, 65, 99), (0, 3, 4), (40, 0, 40)])
def test_strassen(shape):
    rng = np.random.default_rng(sum(shape))
    n, d, m = shape
    for top in (3, 1 << 20, 1 << 27):
        a, b = rng.integers(-top, top, (n, d)), rng.integers(-top, top, (d, m))
        assert (H.strassen(a, b) == a @ b).all() and (H.strassen(a, b, 2) == a @ b).all()


def test_heaps_merge():
    rng = np.random.default_rng(4)
    scores = rng.integers(0, 6, (20, 100))
    heap = H.Heaps(20, 5)
    for a in range(0, 100, 9):
        heap.offer(scores[:, a:a + 9].copy(), a)
    for row, places in zip(scores, heap.place):
        assert places.tolist() == sorted(range(100), key=lambda j: (-row[j], j))[:5]
