"""BagMinHash: unbiased registers, classes against brute force, odd rows."""

import random

import duckdb
import numpy as np

from subsight.llm import minhash as M
from subsight.llm.components import components

from ..conftest import SF001, SF01
from .brute import find, near_classes


def registers(bags, m=4096):
    doc = np.concatenate([np.full(len(b), i) for i, b in enumerate(bags)])
    s = M.mix(np.array([k for b in bags for k in b], np.uint64))
    return M.bag_minhash(doc, s, np.array([c for b in bags for c in b.values()]), len(bags), m)


def test_registers_are_unbiased():
    rng = random.Random(1)
    for top in (1, 3, 40):
        a = {i: rng.randint(1, top) for i in range(60)}
        b = {i: rng.randint(1, top) for i in range(20, 90)}
        both = sum(min(n, b.get(i, 0)) for i, n in a.items())
        want = both / (sum(a.values()) + sum(b.values()) - both)
        x, y = registers([a, b])
        assert abs((x == y).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5 + 1e-9
        assert np.isfinite(x).all()


def test_signature_does_not_depend_on_the_batch():
    a, b, c = {1: 3, 2: 1, 9: 70}, {i: 1 for i in range(500)}, {7: 1}
    together = registers([a, b, c], 256)
    for i, bag in enumerate((a, b, c)):
        assert (registers([bag], 256)[0] == together[i]).all()


def classes(spark, rows, schema="doc_id long, text string, class_id string, node string, key int"):
    docs = spark.createDataFrame([(*r, None, "x", i) for i, r in enumerate(rows)], schema)
    return docs, sorted(((r["doc_id"], r["class_id"]) for r in M.near_duplicates(docs).collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_odd_rows_and_groups(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(5, None), (4, ""), (6, " \n"), (None, "only null id here ok yes"), (7, "a b"), (8, "a\tb"), (9, "a c"), (9, "a c"),
            (10, "x " * 40000), (3, "x " * 39000), (11, "x " * 20000)]
    rows += [(100 + i, edited(rng, base, rng.randint(0, 14))) for i in range(120)]
    rows += [(300 + i, "the same text again and again") for i in range(200)]
    rows += [(600 + i, " ".join(base[:100]) + " " + " ".join(f"q{i}_{k}" for k in range(60))) for i in range(40)]
    docs, got = classes(spark, rows)
    assert got == near_classes(rows)
    kept = M.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = near_classes(rows)
    assert len(ids) == len({c for _, c in want}) and {i for i in ids if i is not None} == {c for _, c in want if c is not None}
    assert M.near_duplicates(docs.limit(0)).collect() == [] and M.deduplicate(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    for sf in (SF001, SF01):
        rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
        got = sorted(((r["doc_id"], r["class_id"]) for r in M.op4_minhash(spark, sf).collect()), key=str)
        assert got == near_classes(rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        parent[find(parent, a)] = find(parent, b)
    groups = {}
    for x in parent:
        groups.setdefault(find(parent, x), []).append(x)
    want = sorted((x, min(g)) for g in groups.values() for x in g if len(g) > 1)
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
