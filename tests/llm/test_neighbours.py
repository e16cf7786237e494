"""Links and components against all pairs, clumps, shards that split, odd rows."""

import duckdb
import numpy as np

from subsight.llm import neighbours as N

from ..conftest import SF001, SF01
from .brute import find


def brute(rows):
    """rows: (vec_id, embedding, label) -> sorted (vec_id, n_links, component_id)."""
    parent, n = list(range(len(rows))), [0] * len(rows)
    usable = {}
    for i, (_, e, label) in enumerate(rows):
        if label is None or not e or any(x is None for x in e):
            continue
        v = np.array(e, np.float64)
        if np.isfinite(v).all() and v.any():
            usable.setdefault((label, len(v)), []).append((i, v / np.abs(v).max()))
    for group in usable.values():
        ids = [i for i, _ in group]
        x = np.array([v / np.linalg.norm(v) for _, v in group])
        for a, b in zip(*np.nonzero(x @ x.T >= 0.98)):
            if a != b:
                n[ids[a]] += 1
                parent[find(parent, ids[a])] = find(parent, ids[b])
    names = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            names[find(parent, i)] = min(names.get(find(parent, i), d), d)
    return sorted(((d, n[i], names.get(find(parent, i))) for i, (d, _, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in N.near_links(df).collect()), key=str)


def as_float(rows):
    return [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], label) for i, e, label in rows]


def test_odd_rows(spark):
    rows = as_float([(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
                     (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0], 2), (None, [1.0, 0.1], 1),
                     (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1e30, 1e29], 1), (14, [1e-38, 0.0], 1)])
    assert run(spark, rows) == brute(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert N.near_links(empty).collect() == []


def made(rng, n, clump, spread=0.012):
    x = rng.normal(size=(n, 32))
    c = rng.normal(size=32)
    x[:clump] = c / np.linalg.norm(c) + spread * rng.normal(size=(clump, 32))
    x[clump:clump + n // 10] = x[-(n // 10):] * 1.5 + 0.01 * rng.normal(size=(n // 10, 32))
    x[clump + n // 10:clump + n // 5] = x[0]
    return as_float([(i, v.tolist(), int(i % 7 > 4)) for i, v in enumerate(x)])


def test_clumps(spark):
    rows = made(np.random.default_rng(1), 1500, 300)
    assert run(spark, rows) == brute(rows)


def test_shards_that_split(spark, monkeypatch):
    for name, value in (("SHARD", 200), ("PART", 100), ("CHUNK", 150), ("QUERIES", 64)):
        monkeypatch.setattr(N, name, value)
    rows = made(np.random.default_rng(2), 1200, 250)
    got, want = run(spark, rows), brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def test_search_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 24))
    x[100:200] = x[:100] + 0.02 * rng.normal(size=(100, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    adjacent = N.both_ways([v[v >= 0] for v in N.build(x)])
    hit = N.search(x, adjacent, 0, np.arange(800))
    want = x @ x.T >= 0.98
    np.fill_diagonal(want, False)
    assert (hit & ~want).sum() == 0 and hit.sum() >= 0.99 * want.sum()


def test_query_equals_all_pairs(spark):
    for sf in (SF001, SF01):
        rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{sf}/embeddings.parquet'").fetchall()
        got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in N.op3_embedding_dedup(spark, sf).collect()), key=str)
        assert got == brute(rows)


def test_a_clump_is_dealt_in_blocks(spark, monkeypatch):
    """Near copies that no pivot tells apart: every link is found, and no group holds them all."""
    for name, value in (("SHARD", 64), ("PART", 32), ("CHUNK", 100)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(5)
    c = rng.normal(size=16)
    rows = as_float([(i, (c + 0.001 * rng.normal(size=16)).tolist(), 1) for i in range(500)])
    assert run(spark, rows) == brute(rows)
    nodes = N.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    placed = N.write_and_read(N.deal(nodes, 2), "test-dealt")
    for part in N._blocks(placed, placed):
        sizes = [r["count"] for r in part.groupBy("shard", "block", "q_block").count().collect()]
        assert max(sizes) <= 2 * N.SHARD and len(sizes) > 1


def test_links_lead_across_shards(spark, monkeypatch):
    """A long arc, dealt to many shards that are not much wider than a link: pairs without a common shard are found."""
    for name, value in (("SHARD", 100), ("PART", 25), ("CHUNK", 150), ("QUERIES", 64)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(9)
    turn = rng.permutation(np.linspace(0, 3, 700)) + 0.001 * rng.normal(size=700)
    rows = as_float([(i, [float(np.cos(t)), float(np.sin(t)), 0.02 * float(rng.normal()), 0.0], 1) for i, t in enumerate(turn)])
    monkeypatch.setattr(N, "recall", lambda *_: 1.0)  # one run with the first overlap
    assert run(spark, rows) == brute(rows)


def test_a_hub_keeps_its_own_list():
    n = 200
    lists = [np.array([n - 1]) if i < n - 10 else np.zeros(0, int) for i in range(n)]
    lists[-1] = np.arange(n - 8, n - 1)
    assert set(lists[-1]) <= set(N.both_ways(lists)[-1])


def test_no_shard_grows_with_a_clump(spark, monkeypatch):
    """What pivots do not split is dealt by hash: shards and the lists of a vector stay bounded."""
    for name, value in (("SHARD", 64), ("PART", 32), ("CHUNK", 100)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(6)
    c = rng.normal(size=16)
    rows = as_float([(i, (c + 0.001 * rng.normal(size=16)).tolist(), 1) for i in range(600)])
    nodes = N.write_and_read(N.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "test-nodes")
    placed = N.write_and_read(N.deal(nodes, 2), "test-dealt")
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert max(sizes) <= 2 * N.SHARD and placed.select("node").distinct().count() == 600
    lists = N.graph(placed).collect()
    homes = {r["node"]: r["count"] for r in placed.groupBy("node").count().collect()}
    assert len(lists) == 600 and all(0 < len(r["near"]) <= N.DEGREE * homes[r["node"]] for r in lists)


def test_audit_sees_what_is_missing(spark):
    """Every vector with an id divisible by 100 is audited; each that has a link weighs the same."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 16))
    x[1::100], x[2::100] = x[::100] + 0.001, x[::100] - 0.001
    x[300:350] = x[300] + 0.001 * rng.normal(size=(50, 16))  # one clump does not hide the others
    rows = as_float([(i, v.tolist(), 1) for i, v in enumerate(x)])
    nodes = N.write_and_read(N.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "test-nodes")
    full = nodes.selectExpr("node", "if(first_id between 300 and 349, 49, 2) as links")
    assert N.recall(nodes, full) == 1.0
    assert abs(N.recall(nodes, full.join(nodes.filter("first_id <> 100").select("node"), "node")) - 0.8) < 1e-9
    assert abs(N.recall(nodes, full.limit(0)) - 0.0) < 1e-9


def test_a_vector_is_written_twice_however_many_shards_it_is_in(spark, monkeypatch):
    """Tables of shards and visits hold ids only; a round whose shards are searched in steps finds the same."""
    for name, value in (("SHARD", 128), ("PART", 64), ("CHUNK", 500), ("SLICE", 300)):
        monkeypatch.setattr(N, name, value, raising=False)
    wrote, write = [], N.write_and_read
    monkeypatch.setattr(N, "write_and_read", lambda df, name: wrote.append((name, set(df.columns))) or write(df, name))
    rows = made(np.random.default_rng(11), 1200, 100)
    got, want = run(spark, rows), brute(rows)
    assert [name for name, columns in wrote if columns & {"vec", "embedding", "pivot"}] == ["graph-nodes", "graph-members"]
    assert len([name for name, _ in wrote if name == "graph-found"]) >= N.MOST_SLICES
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
