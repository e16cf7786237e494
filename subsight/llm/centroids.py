"""Centroid clustering (operator 11): Lloyd's rounds over integer vectors, pruned by Ptolemaic pivots.

Ptolemy's inequality holds between any four points: for a vector q, a centroid o and two pivots p, s

    d(q, o) * d(p, s) >= | d(q, p) * d(o, s) - d(q, s) * d(o, p) |

so a fixed pair of pivots bounds the distance q to o from below by distances that are known already.
The pivots are the first centroids; a vector's distances to them are computed once and stored beside
it, and the few between centroids and pivots once a round. The largest bound over all pairs of
pivots counts. It is rounded down (``_SLACK`` covers the errors of the products, the division and
the roots), so a centroid is passed over only if it is farther for certain. A vector checks its
centroids exactly, in 64-bit integers, in the order of their bounds, until the next bound exceeds
the best distance; ``n_checked`` counts them.

A round is one pass over the stored vectors. Each task adds up its clusters (k * dims sums), Spark
adds those, and the driver holds the k centroids and nothing else. A round that moves no centroid
is the last one: all later ones would repeat it.

Cases: a null embedding, one of other than ``dims`` components, or one with a null or non-finite
component is left out, as is one with a component beyond ``LIMIT`` after scaling (its distances
would not fit in 64 bits). A null vec_id is kept; it has no hash and starts no centroid unless
fewer than k vectors have one. Repeated rows and ids are vectors of their own; equal starting
vectors make equal centroids, of which the smaller number gets the vectors. With fewer than k
vectors there are as many centroids as vectors; an empty table gives an empty result. Only
``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_and_read

K, ROUNDS, DIMS, SCALE = 8, 10, 64, 1024
LIMIT = 1 << 27  # of a scaled component: 64 squares of differences fit in 63 bits
ROWS = 4096  # assigned together
_SLACK = 2.0**-50


def scaled(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long): the vectors that take part, each component floor(scale * x)."""
    x = F.transform("embedding", lambda c: c.cast("double") * F.lit(float(scale)))
    usable = vectors.select("vec_id", "embedding").filter(
        (F.size("embedding") == dims) & F.forall(x, lambda c: F.coalesce(c >= -LIMIT, F.lit(False)) & F.coalesce(c < LIMIT, F.lit(False))))
    return usable.select("vec_id", F.transform(x, lambda c: F.floor(c).cast("long")).alias("v"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exactly."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([_square(x, p[None, :]) for p in pivots], axis=1).astype(np.float64))


def pivot_bounds(near: np.ndarray, centroid_near: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of vectors (rows) to centroids (columns), from both
    sides' distances to the pivots. Pivots that coincide make no pair."""
    between = _to_pivots(pivots, pivots)
    pairs = [(p, s) for p, s in combinations(range(len(pivots)), 2) if between[p, s] > 0]
    low = np.zeros((len(near), len(centroid_near)))
    for p, s in pairs:
        a = near[:, p, None] * centroid_near[None, :, s]
        b = near[:, s, None] * centroid_near[None, :, p]
        np.maximum(low, (np.abs(a - b) - _SLACK * (a + b)) / between[p, s], out=low)
    return np.square(low * (1 - _SLACK)) * (1 - _SLACK)


def nearest(x: np.ndarray, low: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (the smaller number of equally near ones), its squared
    distance, and how many centroids were checked."""
    rows, order = np.arange(len(x)), np.argsort(low, axis=1, kind="stable")
    cluster = order[:, 0].copy()
    best, checked = _square(x, centroids[cluster]), np.ones(len(x), np.int64)
    for t in range(1, len(centroids)):
        j = order[:, t]
        r = np.flatnonzero(low[rows, j] <= best * (1 + 2.0**-50))
        if not len(r):
            break
        d = _square(x[r], centroids[j[r]])
        better = (d < best[r]) | ((d == best[r]) & (j[r] < cluster[r]))
        checked[r] += 1
        best[r[better]], cluster[r[better]] = d[better], j[r[better]]
    return cluster, best, checked


def _assigned(batches, centroids: np.ndarray, pivots: np.ndarray):
    """(vec_ids, vectors, cluster, distance, checked) of slices of the stored vectors."""
    centroid_near = _to_pivots(centroids, pivots)
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            part = b.slice(a, ROWS)
            x = _matrix(part.column("v"))
            yield part.column("vec_id"), x, *nearest(x, pivot_bounds(_matrix(part.column("near")), centroid_near, pivots), centroids)


def _means(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; an empty cluster's one stays."""
    k, dims = centroids.shape

    def add(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x, cluster, _, _ in _assigned(batches, centroids, pivots):
            for j in np.unique(cluster):
                mine = x[cluster == j]
                n[j] += len(mine)
                total[j] += mine.sum(axis=0)
        j, at = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
        yield pa.RecordBatch.from_pydict({"cluster": j.astype(np.int32), "at": at.astype(np.int32), "n": n[j], "total": total[j, at]})

    sums = (stored.mapInArrow(add, "cluster int, at int, n long, total long").groupBy("cluster", "at")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    out = centroids.copy()
    for r in sums.collect():  # k * dims numbers
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, n_checked of
    every vector that takes part."""
    rows = write_and_read(scaled(vectors, dims, scale), "cluster-vectors")
    spark = rows.sparkSession
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "vec_id", "v").orderBy(F.asc_nulls_last("key"), "vec_id", "v").limit(k).collect()
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_checked long")
    centroids = np.array([r["v"] for r in first], np.int64)
    pivots = centroids

    def measure(batches):
        for b in batches:
            near = _to_pivots(_matrix(b.column("v")), pivots)
            values = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), values], ["vec_id", "v", "near"])

    stored = write_and_read(rows.mapInArrow(measure, f"vec_id {id_type}, v array<long>, near array<double>"), "cluster-pivots")
    for _ in range(rounds):
        moved = _means(stored, centroids, pivots)
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(batches):
        for ids, _, c, d, n in _assigned(batches, centroids, pivots):
            yield pa.RecordBatch.from_arrays([ids, pa.array(c.astype(np.int32)), pa.array(d), pa.array(n)], ["vec_id", "cluster", "distance", "n_checked"])

    found = write_and_read(stored.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long, n_checked long"), "cluster-found")
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    by_cluster = found.groupBy("cluster").agg(total("distance").alias("one"))  # k rows, as are the digests
    every = by_cluster.agg(total("one").cast("long").alias("inertia"))
    facts = by_cluster.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").crossJoin(every)
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", F.col("one").cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256", "n_checked")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return cluster(read(spark, sf_dir, "embeddings")).drop("n_checked")


def _oracle() -> str:
    """The rounds, one after another."""
    ctes = ["""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v
  FROM kept QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8)"""]
    for i in range(ROUNDS + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT k.vec_id, any_value(k.v) AS v,
         min({{'d': CAST(list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c{i}.c}}) AS near
  FROM kept k, c{i} GROUP BY k.vec_id)""")
        if i < ROUNDS:
            ctes.append(f"""m{i} AS MATERIALIZED (
  SELECT c, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT near.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY c, place)""")
            ctes.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM m{i} GROUP BY c
  UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM m{i}))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, CAST(a.near.c AS INTEGER) AS cluster, a.near.d AS distance,
       CAST(sum(a.near.d) OVER (PARTITION BY a.near.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.near.c"""


ORACLE_SQL = _oracle()
