"""Budgets by water-filling, cuts against a plain version, odd rows."""

import re

import duckdb
import pytest

from subsight.llm import mixing as M

from ..conftest import SF001, SF01


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Reshare round by round until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    target, fixed, own = {}, set(), dict(sizes)
    while True:
        left = sum(own.values()) - sum(3 * own[s] for s in fixed)
        total = sum(weight[s] for s in own if s not in fixed)
        target = {s: 3 * own[s] if s in fixed else left * weight[s] / total for s in own}
        above = {s for s in own if s not in fixed and target[s] > 3 * own[s] + 1e-9}
        if not above:
            return target
        fixed |= above


@pytest.mark.parametrize("sizes", [
    [("a", 10), ("b", 1000), (None, 5)], [("x", 0), ("y", 100)], [("a", 7)], [("b", 1), ("a", 1), ("c", 10**6), ("d", 3), ("\U0001F600", 50), ("￿", 60)], []])
def test_targets(sizes):
    got = M.targets(sizes)
    assert got == pytest.approx(plain_targets(sizes) if sizes else {})


def check(rows, got):
    """rows: (doc_id, text, source); got: the operator's rows."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = plain_targets(list(sizes.items()))
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((d, size(t)) for d, t, _ in rows), key=str)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] + r["cut"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert taken == {s: round(target[s]) if sizes[s] else 0 for s in sizes}
    # the cut is by key: whole documents, at most one in part, then none
    for s in sizes:
        cuts = [(r["cut"], r["size"]) for r in sorted((r for r in got if r["source"] == s), key=lambda r: (r["key"], -r["cut"])) if r["size"]]
        part = [i for i, (c, n) in enumerate(cuts) if 0 < c < n]
        assert len(part) <= 1
        last = max([i for i, (c, _) in enumerate(cuts) if c], default=-1)
        assert all(c == n for c, n in cuts[:max(last, 0)])


def test_query(spark):
    for sf in (SF001, SF01):
        rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{sf}/documents.parquet'").fetchall()
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        check(rows, M.mix(docs).collect())
        first, again = (sorted(map(tuple, M.op7_mixing(spark, sf).collect())) for _ in range(2))
        assert first == again


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "one", None), (4, "w " * 50000, "big"), (None, "a b", "a"), (6, "c\td\n", "b"), (6, "c\td\n", "b")]
    rows += [(i, "some words " * (i % 5), "hot") for i in range(10, 400)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, key string")
    check(rows, M.mix(docs).collect())
    empty = docs.limit(0)
    assert M.mix(empty).collect() == [] and M.repeat(empty).collect() == []
    mixed = M.repeat(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + size(r["text"])
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    for s, t in plain_targets(list(sizes.items())).items():
        largest = max((size(r[1]) for r in rows if r[2] == s), default=0)
        assert abs(words.get(s, 0) - t) <= largest + 1


def test_equal_rows_are_cut_one_by_one(spark):
    rows = [(7, "three equal words", "a")] * 1000 + [(i, "some other words here", "b") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = M.repeat(docs).groupBy("source").count().collect()
    want = plain_targets([("a", 3000), ("b", 3600)])
    for r in got:
        words = 3 if r["source"] == "a" else 4
        assert abs(r["count"] * words - want[r["source"]]) <= words
