"""Unique names inside a batch of updates: handed on, swapped, wanted by many; running aggregates."""

import random

import pytest
from pyspark.sql import functions as F

from subsight.operators import changes as CH
from subsight.operators import ids
from subsight.operators import plan_jobs as PJ
from subsight.plans.catalog import all_queries

from .conftest import SF001
from .oracle_check import compare, duck
from .test_stream_state import AS_OF, plan_cmds, plans


def serial(owned, cmds):
    """owned: id -> name; cmds: (seq, id, name). Which seqs are refused."""
    held, refused = dict(owned), set()
    for seq, i, name in sorted(cmds):
        if i not in held:
            continue
        if name is not None and any(n == name and j != i for j, n in held.items()):
            refused.add(seq)
        else:
            held[i] = name
    return refused


def refused(spark, owned, cmds):
    c = spark.createDataFrame(cmds, "seq long, id long, _key string")
    o = spark.createDataFrame([(n, i) for i, n in owned.items()], "_key string, _owner long")
    known = o.select(F.col("_owner").alias("id"), F.lit(True).alias("_exists"))
    out = CH.with_claims(c.join(known, "id", "left"), o, "id").collect()
    assert len(out) == len(cmds)
    return {r["seq"] for r in out if r["_clash"]}


START = {1: "a", 2: "b", 3: "c"}


@pytest.mark.parametrize("cmds", [
    [(1, 1, "x"), (2, 2, "a"), (3, 1, "b")],  # a swap by way of a third name
    [(1, 1, "b"), (2, 2, "a")],  # a swap that cannot begin
    [(1, 3, "x"), (2, 2, "c"), (3, 1, "b")],  # a chain that opens up
    [(1, 1, "b"), (2, 2, "c"), (3, 3, "x"), (4, 2, "c"), (5, 1, "b")],  # refused first, free later
    [(1, 3, "a"), (2, 2, "c"), (3, 1, "b"), (4, 1, "c")],  # a cascade of refusals
    [(1, 9, "a"), (2, 1, "x"), (3, 9, "x"), (4, 2, "x")],  # unknown ids claim nothing
    [(1, 1, "a"), (2, 1, "a"), (3, 2, "a")],  # a row keeps its own name
    [(1, 1, None), (2, 2, "a"), (3, 3, None)],
])
def test_small_batches(spark, cmds):
    assert refused(spark, START, cmds) == serial(START, cmds)


def test_random_batches(spark):
    rng = random.Random(7)
    for n, names in ((60, 8), (120, 4)):
        owned = {i: f"n{i}" for i in range(6)}
        cmds = [(s, 0 if rng.random() < 0.3 else rng.randrange(7), "n0" if rng.random() < 0.3 else f"n{rng.randrange(names)}") for s in range(n)]
        assert refused(spark, owned, cmds) == serial(owned, cmds)


def test_long_chain_needs_two_rounds(spark, monkeypatch):
    rounds = []
    write = CH._rewritten
    monkeypatch.setattr(CH, "_rewritten", lambda df, name: rounds.append(name) or write(df, name))
    owned = {i: f"n{i}" for i in range(300)}
    cmds = [(1000 - i, i, f"n{i + 1}") for i in range(300)]  # from the last row on, each takes its follower's name
    assert refused(spark, owned, cmds) == set() and len(rounds) <= 3


def test_plans_swap_names(spark):
    r = PJ.update(plans(spark), plan_cmds(spark, [(1, 1, "tmp"), (2, 2, "A"), (3, 1, "b"), (4, 3, "TMP")]), AS_OF)
    assert all(x["accepted"] for x in r.outcome.collect())
    assert sorted((x["plan_id"], x["name"]) for x in r.upserts["plans"].collect()) == [(1, "b"), (2, "A"), (3, "TMP")]


@pytest.mark.parametrize("name", ["update_plans_chain", "update_users_chain", "update_plans", "update_users", "update_plans_rows", "update_users_rows"])
def test_queries_equal_their_sql(spark, name):
    problems, n = compare(spark, name, all_queries()[name], SF001, duck(SF001))
    assert problems == [] and n > 0


def test_running_over_a_hot_group(spark):
    data = [(0 if i % 3 else i % 5, i, (i * 37) % 11 if i % 4 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "g int, o int, v int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _running(spark, df, data)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _running(spark, df, data):
    assert df.repartitionByRange("g", "o").withColumn("p", F.spark_partition_id()).where("g = 0").select("p").distinct().count() > 1
    for how, fn in (("sum", sum), ("max", max)):
        got = {r["o"]: r["x"] for r in ids.running(df, ["g"], "o", "v", "x", how).collect()}
        seen, want = {}, {}
        for g, o, v in data:
            want[o] = fn(seen[g]) if seen.get(g) else None
            if v is not None:
                seen.setdefault(g, []).append(v)
        assert got == want
