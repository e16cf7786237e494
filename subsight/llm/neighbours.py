"""Embedding near-duplicates (operator 3): a robust-pruned flat graph, searched by range.

Vectors of one label (and dimension) are dealt to overlapping shards: a shard that is too large is
split by pivots drawn from it, and each vector goes to the shards of its nearest pivots and of the
first pivot within the link radius. What pivots do not split (a clump, or what is left after
``DEPTH`` rounds) is dealt by hash, each vector to ``overlap`` parts, so no shard grows with the data.

Build: in each shard, vectors get robust-pruned lists of neighbours. A vector's lists from all its
shards are united. Search: every vector walks greedily from the medoid of each of its shards (and
from its own list) over the united lists, with a beam; everything within ``SLACK`` of the range is
expanded until nothing new comes near. Cosines are taken in double precision, so each link is
verified when it is found.

The search leaves the shards. An edge of the united lists that leads out of a shard lies in another
shard of the same vector, so a walk goes on in all other shards of the vectors in range (and of the
``LEAD`` nearest ones), starting there from the vector that led to it; vectors that are found walk
back. Rounds go on until no walk reaches a new shard. A pair that meets in several shards is counted
in the first round and shard.

Audit: all vectors that have an id divisible by ``AUDITED`` meet all vectors of their label, in
blocks. Recall is averaged over those that have a link; below ``MIN_RECALL`` the overlap is doubled
and the search runs again; a last overlap that is still below gives a warning with the figures.

On disk: a vector is written with its node, as the floats it came as, and once more with its lists
and shards; it is scaled to length 1 where it is used. Tables of shards and visits hold ids, and a
vector is shuffled to its shards when they are built or searched. A round searches its shards in
up to ``MOST_SLICES`` steps; shuffle files go when the step that needed them has been written.

Equal vectors of one label are one node with a count from the start, so thousands of copies cost
one search. Only links to the smallest found vector leave a group, never a row per pair. The number
of links of each of k distinct near copies takes k walks through all shards of the clump; they are
spread over (k / SHARD)^2 groups of bounded size.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
without a label, link with nothing: component_id is their own id. A null vec_id names no
component; repeated rows and ids are vectors of their own; an empty table gives an empty result;
only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import logging
import warnings
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import write_and_read
from .components import components

COSINE = 0.98
SHARD = 512  # a larger shard is split ...
PART = 128  # ... by a pivot for about so many vectors
PIVOTS = 1024  # at most, for one split
MOST_OVERLAP = 64
SLICE, MOST_SLICES = 250_000, 8  # walks whose shards are searched in one step, and steps of a round
CHUNK = 50_000  # vectors of one shard that are dealt together
DEPTH = 8
CANDIDATES, DEGREE, ALPHA = 48, 16, 1.2
BEAM, WIDTH = 32, 8
LEAD = 2  # nearest vectors whose shards are visited, in range or not
SLACK = 0.01  # so far below the range a vector is still expanded
QUERIES = 256  # searched together
ASSIGNED = 4096  # vectors that are compared with a shard's pivots together
LEAST_BLOCK, BLOCK_VALUES = 2048, 2**21  # vectors, and numbers at most, of a block of the audit
AUDITED = 100  # every vector with an id divisible by it is audited
MIN_RECALL = 0.95
_LOG = logging.getLogger(__name__)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors in double precision, scaled to length 1."""
    x = _matrix(column).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vec(nodes: DataFrame) -> Column:
    """Floats stay floats in files and shuffles; other numbers become doubles."""
    kind = nodes.schema["embedding"].dataType.elementType
    return (F.col("embedding") if isinstance(kind, T.FloatType) else F.col("embedding").cast("array<double>")).alias("vec")


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of the steps in between go when a step has been written, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """The distinct usable vectors of each label: node, shard, n (copies), first_id, whether it is
    audited, and the embedding."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists(v, lambda x: x != 0))
    one = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"),
                                                 F.coalesce(F.max(F.col("vec_id") % AUDITED == 0), F.lit(False)).alias("audited"))
    return one.select(F.monotonically_increasing_id().alias("node"), F.concat_ws("/", F.col("label").cast("string"), F.size("embedding")).alias("shard"),
                      "n", "first_id", "audited", "label", "embedding")


def deal(nodes: DataFrame, overlap: int) -> DataFrame:
    """(node, shard, vec): every vector in the overlapping shards it belongs to."""
    return _homes(nodes, overlap).join(nodes.select("node", _vec(nodes)), "node")


def _homes(nodes: DataFrame, overlap: int) -> DataFrame:
    """(node, shard): the overlapping shards of every vector."""
    radius2 = 2 - 2 * COSINE
    vectors = nodes.select("node", _vec(nodes))
    placed = nodes.select("node", "shard", F.lit(False).alias("done"))
    sizes = placed.groupBy("shard", "done").agg(F.count("*").alias("size"))
    for _ in range(DEPTH):
        large = sizes.filter(~F.col("done") & (F.col("size") > SHARD)).select(
            F.col("shard").alias("s"), "size", F.least(F.lit(PIVOTS), F.ceil(F.col("size") / PART)).alias("k"),
            F.ceil(F.col("size") / CHUNK).alias("chunks"))
        if large.isEmpty():
            break
        rows = placed.join(large, F.col("shard") == F.col("s"))
        by_hash = Window.partitionBy("shard").orderBy(F.xxhash64("node"), "node")
        pivots = rows.withColumn("rank", F.row_number().over(by_hash)).filter((F.col("rank") <= PIVOTS) & (F.col("rank") <= F.col("k")))
        pivots = pivots.join(vectors, "node").select(F.col("shard").alias("of"), "rank", F.col("vec").alias("pivot"),
                                                     F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        chunked = rows.select("node", "shard", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")).join(vectors, "node")

        def assign(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"node": pa.array([], pa.int64()), "shard": pa.array([], pa.string())})
            p, parent = _units(right.sort_by("rank")["pivot"]), left["shard"][0].as_py()
            node, shard = [], []
            for a in range(0, left.num_rows, ASSIGNED):
                part = left.slice(a, ASSIGNED)
                near = 2 - 2 * (_units(part["vec"]) @ p.T)
                take = np.zeros(near.shape, bool)
                best = np.argsort(near, axis=1, kind="stable")[:, :overlap]
                np.put_along_axis(take, best, True, axis=1)
                close = near <= radius2
                has = close.any(axis=1)
                take[has, close[has].argmax(axis=1)] = True
                i, j = np.nonzero(take)
                node.append(part["node"].to_numpy()[i])
                shard += [f"{parent}.{k}" for k in j]
            return pa.table({"node": np.concatenate(node), "shard": pa.array(shard, pa.string())})

        split = chunked.groupBy("shard", "chunk").cogroup(pivots.groupBy("of", "chunk")).applyInArrow(assign, "node long, shard string")
        rest = placed.join(large, F.col("shard") == F.col("s"), "left_anti")
        split = write_and_read(split, "graph-split")
        # a part that is hardly smaller than its shard is a clump; it is not split again
        parent = large.select(F.col("s").alias("p"), F.col("size").alias("was"))
        parts = split.groupBy("shard").agg(F.count("*").alias("size")).withColumn("p", F.regexp_replace("shard", r"\.\d+$", ""))
        parts = parts.join(parent, "p").select(F.col("shard").alias("s"), (F.col("size") > 0.9 * F.col("was")).alias("done"))
        split = split.join(parts, F.col("shard") == F.col("s")).select("node", "shard", "done")
        placed = write_and_read(rest.unionByName(split), "graph-placed")
        sizes = placed.groupBy("shard", "done").agg(F.count("*").alias("size"))
    # what pivots did not split: by hash, each vector to several parts, so that walks lead across
    large = sizes.filter(F.col("size") > SHARD).select(F.col("shard").alias("s"), F.ceil(F.col("size") * overlap / SHARD).alias("parts"))
    part = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(overlap)), lambda i: F.pmod(F.xxhash64("node", i), F.col("parts"))))
    names = F.when(F.col("parts").isNull(), F.array("shard")).otherwise(F.transform(part, lambda i: F.concat_ws("#", "shard", i.cast("string"))))
    return placed.join(large, F.col("shard") == F.col("s"), "left").select("node", F.explode(names).alias("shard"))


def prune(x: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of candidate lists (nearest first): up to ``degree`` neighbours of each row, -1 beyond."""
    n, k = near.shape
    out = np.full((n, degree), -1, np.int64)
    for a in range(0, n, QUERIES):
        ids = near[a:a + QUERIES]
        c = x[ids]
        own = np.sqrt(np.maximum(2 - 2 * np.einsum("qkd,qd->qk", c, x[a:a + len(ids)]), 0))
        left = np.ones(ids.shape, bool)
        for r in range(min(degree, k)):
            open_ = left.any(axis=1)
            if not open_.any():
                break
            first = left.argmax(axis=1)
            rows = np.flatnonzero(open_)
            out[a + rows, r] = ids[rows, first[rows]]
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("qkd,qd->qk", c, c[np.arange(len(ids)), first]), 0))
            left &= alpha * between > own
            left[np.arange(len(ids)), first] = False
    return out


def build(x: np.ndarray) -> np.ndarray:
    """The flat graph of a shard: pruned neighbours of each vector."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    near = np.zeros((n, k), np.int64)
    for a in range(0, n, QUERIES) if k else ():
        s = x[a:a + QUERIES] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near[a:a + len(s)] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return prune(x, near)


def both_ways(lists: list[np.ndarray]) -> np.ndarray:
    """Adjacency lists with their reverse edges (the first ones, up to the longest list), padded with -1."""
    n = len(lists)
    a = np.repeat(np.arange(n), [len(v) for v in lists])
    b = np.concatenate(lists).astype(np.int64) if n else np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    pairs = pairs[np.lexsort((~np.isin(pairs, a * n + b), pairs // n if n else pairs))]  # a vector's own list first
    a, b = pairs // n, pairs % n
    a, b = a[a != b], b[a != b]
    width = max(1, 2 * max((len(v) for v in lists), default=1))
    place = np.arange(len(a)) - np.searchsorted(a, a)
    # a hub keeps its own list and the first edges to it; all edges still lead away from the others
    keep = place < max(width, 2 * DEGREE)
    out = np.full((n, int(place[keep].max(initial=0)) + 1), -1, np.int64)
    out[a[keep], place[keep]] = b[keep]
    return out


def walk(x: np.ndarray, adjacent: np.ndarray, q: np.ndarray, start: np.ndarray, threshold: float = COSINE) -> np.ndarray:
    """Cosines of the vectors ``q`` (rows) to the vectors ``x`` (columns) that their walks reached, -inf for
    the others. Each walk starts at its row of ``start`` (-1: nothing) and goes on greedily with a beam;
    then everything within SLACK of the threshold is expanded, until nothing new is."""
    n, rows = len(x), np.arange(len(q))
    sim = np.full((len(q), n), -np.inf)
    opened = np.zeros((len(q), n), bool)

    def take(i: np.ndarray, c: np.ndarray) -> None:
        for a in range(0, len(i), 100_000):
            f = slice(a, a + 100_000)
            sim[i[f], c[f]] = np.einsum("ij,ij->i", q[i[f]], x[c[f]])

    # greedily: the best vectors of the beam are opened until none of them is closed
    beam, known = np.full((len(q), BEAM), -1, np.int64), np.full((len(q), BEAM), -np.inf)
    live, near = rows, start
    while len(live):
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[sim[live[:, None], near] > -np.inf] = -1
        i, j = np.nonzero(near >= 0)
        take(live[i], near[i, j])
        c = np.concatenate((beam[live], near), axis=1)
        s = np.where(c >= 0, sim[live[:, None], c], -np.inf)
        top = np.argpartition(-s, BEAM - 1, axis=1)[:, :BEAM]
        beam[live], known[live] = np.take_along_axis(c, top, 1), np.take_along_axis(s, top, 1)
        s = np.where(opened[live[:, None], beam[live]], -np.inf, known[live])
        pick = np.argpartition(-s, WIDTH - 1, axis=1)[:, :WIDTH]
        use = np.take_along_axis(s, pick, 1) > -np.inf
        go = use.any(axis=1)
        live, pick, use = live[go], pick[go], use[go]
        pick = beam[live[:, None], pick]
        opened[live[:, None], np.where(use, pick, pick[np.arange(len(live)), use.argmax(axis=1)][:, None])] = True
        near = np.where(use[:, :, None], adjacent[pick], -1).reshape(len(live), WIDTH * adjacent.shape[1])
    while True:
        r, c = np.nonzero((sim >= threshold - SLACK) & ~opened)
        if not len(r):
            return sim
        opened[r, c] = True
        for a in range(0, len(r), 100_000):
            fresh = np.zeros((len(q), n + 1), bool)  # the last column takes the -1
            fresh[r[a:a + 100_000, None], adjacent[c[a:a + 100_000]]] = True
            take(*np.nonzero(fresh[:, :n] & (sim == -np.inf)))


def search(x: np.ndarray, adjacent: np.ndarray, medoid: int, q: np.ndarray, threshold: float = COSINE) -> np.ndarray:
    """Which vectors (columns) are in range of the vectors at ``q`` (rows), as far as the graph shows them."""
    start = np.concatenate((np.full((len(q), 1), medoid), adjacent[q]), axis=1)
    hit = walk(x, adjacent, x[q], start, threshold) >= threshold
    hit[np.arange(len(q)), q] = False
    return hit


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of linked vectors, in place: the smallest place names a class."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


_GO = pa.list_(pa.struct([("shard", pa.string()), ("entry", pa.int64())]))
_FOUND = "node long, links long, root long, go array<struct<shard: string, entry: long>>"


def _blocks(queries: DataFrame, members: DataFrame, size: Column | None = None, q_size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and members of a shard, dealt by hash to (shard, block, q_block) groups in which each
    query meets each member once: a group holds about ``size`` members and ``q_size`` queries (SHARD
    of either if nothing is said; both may name ``count``, the shard's), however large the shard is."""
    blocks_of = lambda of, most, name: of.groupBy("shard").agg(F.count("*").alias("count")).select(
        "shard", F.ceil(F.col("count") / (F.lit(SHARD) if most is None else most)).alias(name))
    counts = blocks_of(members, size, "blocks").join(blocks_of(queries, q_size, "q_blocks"), "shard")
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = queries.join(counts, "shard").withColumn("q_block", dealt("q_blocks")).withColumn("block", every("blocks"))
    m = members.join(counts, "shard").withColumn("block", dealt("blocks")).withColumn("q_block", every("q_blocks"))
    q, m = q.drop("blocks", "q_blocks"), m.drop("blocks", "q_blocks")
    return q, m.toDF(*m.columns)  # columns of its own: both may come from one table


def _codes(sets: list, names: dict[str, int]) -> np.ndarray:
    """One row per set of shards: 1 in the column of each of its names."""
    out = np.zeros((len(sets), len(names)), np.float32)
    for i, own in enumerate(sets):
        for name in own:
            if name in names:
                out[i, names[name]] = 1
    return out


def graph(placed: DataFrame) -> DataFrame:
    """(node, near): the pruned lists of each shard, united by node."""

    def lists(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        near = build(_units(table["vec"]))
        return pa.table({"node": table["node"], "near": pa.array([node[v[v >= 0]] for v in near], pa.list_(pa.int64()))})

    every = placed.groupBy("shard").applyInArrow(lists, "node long, near array<long>")
    return every.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _places(of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted nodes are in ``of``, -1 if they are not there."""
    order = np.argsort(of)
    at = np.minimum(np.searchsorted(of, wanted, sorter=order), len(of) - 1)
    return np.where(of[order[at]] == wanted, order[at], -1)


def _united(right: pa.Table, other: np.ndarray) -> np.ndarray:
    """The united lists of a shard's vectors, as far as they stay in it, both ways."""
    near = right["near"].combine_chunks()
    sizes = np.diff(near.offsets.to_numpy())
    to = _places(other, near.flatten().to_numpy()) if sizes.sum() else np.zeros(0, np.int64)
    return both_ways([v[v >= 0] for v in np.split(to, np.cumsum(sizes)[:-1])])


def _search_shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """Walks of the queries (left) over the graph of a shard (right). A found pair is counted unless
    it met before: in an earlier round, or in an earlier one of this round's shards. ``go`` are the
    shards to walk on in, each with the vector that leads there."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64()),
                         "go": pa.array([], _GO)})
    shard = left["shard"][0].as_py()
    own, other = left["node"].to_numpy(), right["node"].to_numpy()
    x, y, copies = _units(left["vec"]), _units(right["vec"]), right["n"].to_numpy().astype(np.float64)
    adjacent = _united(right, other)
    at, entry = _places(other, own), _places(other, left["entry"].to_numpy())
    medoid = np.full(len(own), int((y @ y.sum(axis=0)).argmax()))
    start = np.concatenate((np.stack((medoid, at, entry), axis=1), np.where((at >= 0)[:, None], adjacent[at], -1)), axis=1)
    own_homes, homes, before = left["shards"].to_pylist(), right["shards"].to_pylist(), left["before"].to_pylist()
    names = {name: i for i, name in enumerate(sorted({name for h in own_homes + homes for name in h} - {shard}))}
    home, own_home = _codes(homes, names), _codes(own_homes, names)
    met = _codes([[*b, *(name for name in f if name < shard)] for b, f in zip(before, left["fresh"].to_pylist())], names)
    lead = 0 if any(before) else min(LEAD, len(other) - 1)
    hit = np.zeros((len(own), len(other)), bool)
    own_go = np.full((len(own), len(names)), -2, np.int64)  # -2: not there; else the node that leads there
    for a in range(0, len(own), QUERIES):
        q = slice(a, a + QUERIES)
        s = walk(y, adjacent, x[q], start[q])
        s[own[q, None] == other[None, :]] = -np.inf
        hit[q] = s >= COSINE
        if names:
            ahead = hit[q].copy()
            if lead:
                top = np.argpartition(-s, lead - 1, axis=1)[:, :lead]
                np.put_along_axis(ahead, top, np.take_along_axis(s, top, 1) > -np.inf, axis=1)
                ahead |= hit[q]
            s[~ahead] = -np.inf
            for t in range(len(names)):
                there = np.flatnonzero(home[:, t])
                if len(there):
                    best = s[:, there].argmax(axis=1)
                    own_go[q, t] = np.where(s[np.arange(len(s)), there[best]] > -np.inf, other[there[best]], -2)
    # a link that one of two vectors found is the other's too
    inside = np.flatnonzero(at >= 0)
    both = hit[np.ix_(inside, at[inside])]
    hit[np.ix_(inside, at[inside])] = both | both.T
    node, place = np.unique(np.concatenate((own, other)), return_inverse=True)
    own_at, other_at = place[:len(own)], place[len(own):]
    links, labels = np.zeros(len(node), np.int64), np.arange(len(node))
    go = np.full((len(node), len(names)), -2, np.int64)
    go[own_at] = own_go
    for t in range(len(names)):  # vectors that were found walk back
        there = np.flatnonzero(own_home[:, t])
        back = hit[there].any(axis=0) if len(there) else np.zeros(len(other), bool)
        if back.any():
            go[other_at[back], t] = np.maximum(go[other_at[back], t], own[there[hit[there][:, back].argmax(axis=0)]])
    for a in range(0, len(own), QUERIES):
        q = slice(a, a + QUERIES)
        r, c = np.nonzero(hit[q])
        _join_labels(labels, own_at[q][r], other_at[c])
        new = hit[q] & ~(met[q] @ home.T > 0) if names else hit[q]
        links[own_at[q]] += (new @ copies).astype(np.int64)
    every = list(names)
    return pa.table({"node": pa.array(node), "links": pa.array(links), "root": pa.array(node[labels]),
                     "go": pa.array([[(every[t], int(g[t])) for t in np.flatnonzero(g > -2)] for g in go], _GO)})


def _search_rows(table: pa.Table) -> pa.Table:
    """A block of a shard: rows of its members, and rows that ask."""
    return _search_shard(table.filter(table["asks"]), table.filter(table["member"]))


def _rows(members: DataFrame, places: DataFrame, before: DataFrame | None, fresh: DataFrame | None) -> DataFrame:
    """The rows of all blocks: each vector is joined with its places once and goes to them."""
    at = places.groupBy("node").agg(F.collect_list(F.struct("shard", "q_block", "member", "asks", "entry")).alias("at"))
    rows = members.join(at, "node")
    if before is None:
        rows = rows.withColumns({"before": F.array().cast("array<string>"), "fresh": F.col("shards")})
    else:
        rows = rows.join(before, "node", "left").join(fresh, "node", "left")
    only = lambda of, name: F.when(F.col(of), F.col(name)).alias(name)
    return rows.withColumn("at", F.explode("at")).select("node", "vec", "shards", "n", "near", "before", "fresh", "at.*").select(
        "shard", "q_block", "node", "vec", "shards", "member", "asks", "entry", only("member", "n"), only("member", "near"),
        only("asks", "before"), only("asks", "fresh"))


def _found(nodes: DataFrame, overlap: int) -> DataFrame:
    """(node, links, root) from every shard that a node walks in, round by round."""
    homes = write_and_read(_homes(nodes, overlap), "graph-homes")
    vectors = nodes.select("node", _vec(nodes), "n")
    lists = graph(homes.join(vectors.drop("n"), "node"))
    shards = homes.groupBy("node").agg(F.collect_set("shard").alias("shards"))
    members = write_and_read(vectors.join(shards, "node").join(lists, "node"), "graph-members")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("q_blocks"))
    cols = ("node", "links", "root")
    visits, visited, before, fresh, all_found = homes, homes, None, None, None
    while True:
        first, go = all_found is None, None
        slices = min(MOST_SLICES, max(1, -(-visits.count() // SLICE)))
        for i in range(slices):
            of = lambda df: df.filter(F.pmod(F.xxhash64("shard"), F.lit(slices)) == i)  # noqa: B023, E731
            # a shard is small, but many may walk in it: they are dealt to blocks, each with the whole shard
            counts = of(visits).groupBy("shard").agg(F.ceil(F.count("*") / SHARD).alias("q_blocks"))
            there = of(homes).join(counts, "shard").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)))
            there = there.select("node", "shard", "q_block", F.lit(True).alias("member"), (F.lit(first) & (own == F.col("q_block"))).alias("asks"),
                                 F.lit(-1).cast("long").alias("entry"))
            if not first:
                there = there.unionByName(of(visits).join(counts, "shard").select(
                    "node", "shard", own.alias("q_block"), F.lit(False).alias("member"), F.lit(True).alias("asks"), "entry"))
            rows = _rows(members, there, before, fresh)
            found = write_and_read(rows.groupBy("shard", "q_block").applyInArrow(_search_rows, _FOUND), "graph-found")
            all_found = found.select(*cols) if all_found is None else all_found.unionByName(found.select(*cols))
            go = found.select("node", "go") if go is None else go.unionByName(found.select("node", "go"))
        visits = go.select("node", F.explode("go").alias("go")).groupBy("node", F.col("go.shard").alias("shard")).agg(F.max("go.entry").alias("entry"))
        visits = write_and_read(visits.join(visited, ["node", "shard"], "left_anti"), "graph-visits")
        if visits.isEmpty():
            return all_found
        before = visited.groupBy("node").agg(F.collect_set("shard").alias("before"))
        fresh = visits.groupBy("node").agg(F.collect_set("shard").alias("fresh"))
        visited = visited.unionByName(visits.select("node", "shard"))


def _count_true(left: pa.Table, right: pa.Table) -> pa.Table:
    """How many vectors of a block (right) are linked with each audited one (left)."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"node": pa.array([], pa.int64()), "n_true": pa.array([], pa.int64())})
    own, other, n = left["node"].to_numpy(), right["node"].to_numpy(), right["n"].to_numpy()
    x, y = _units(left["vec"]), _units(right["vec"])
    true = [((x[a:a + QUERIES] @ y.T >= COSINE) & (own[a:a + QUERIES, None] != other[None, :])) @ n for a in range(0, len(own), QUERIES)]
    return pa.table({"node": pa.array(own), "n_true": pa.array(np.concatenate(true).astype(np.int64))})


def recall(nodes: DataFrame, links: DataFrame) -> float:
    """The share of its links that an audited vector got, averaged over those that have one."""
    key = ("shard", "block", "q_block")
    # an audited vector goes to every block: so there are few, of so many numbers as a task can hold
    most = F.greatest(F.lit(1), F.lit(BLOCK_VALUES) / F.substring_index("shard", "/", -1).cast("int"))
    size = F.least(most, F.greatest(F.lit(LEAST_BLOCK), F.col("count") / 8))
    q, m = _blocks(nodes.filter("audited").select("node", "shard", _vec(nodes)), nodes.select("node", "shard", _vec(nodes), "n"), size, most / 2)
    true = q.groupBy(*key).cogroup(m.groupBy(*key)).applyInArrow(_count_true, "node long, n_true long")
    true = true.groupBy("node").agg(F.sum("n_true").alias("n_true")).filter("n_true > 0")
    share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("n_true"))
    r = true.join(links, "node", "left").agg(F.count("*").alias("n"), F.avg(share).alias("recall")).first()
    _LOG.info("recall %s over %d audited vectors with a link", r["recall"], r["n"])
    return 1.0 if r["recall"] is None else float(r["recall"])


def near_links(vectors: DataFrame, overlap: int = 2) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    with _shuffles_removed(vectors.sparkSession):
        nodes = write_and_read(nodes_of(vectors.select("vec_id", "embedding", "label")), "graph-nodes")
        while True:
            found = _found(nodes, overlap)
            reached = recall(nodes, found.groupBy("node").agg(F.sum("links").alias("links")))
            if reached >= MIN_RECALL:
                break
            if overlap >= MOST_OVERLAP:
                warnings.warn(f"the audited vectors got {reached:.4f} of their links, below {MIN_RECALL}")
                break
            overlap *= 2
        edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(edges)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "n", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"))
    named = (named.join(names, F.col("root") == F.col("r")).join(links, "node", "left")
             .select(F.col("node").alias("of"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    same = nodes.select(F.col("label").alias("l"), F.col("embedding").alias("e"), "node")
    out = vectors.select("vec_id", "embedding", "label").join(same, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    out = out.select("vec_id", "node").join(named, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return near_links(read(spark, sf_dir, "embeddings"))
