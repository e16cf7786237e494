"""Hard-negative mining (operator 12): integer scores by Strassen's products, kept in mergeable heaps.

Components become integers, so a score (the inner product) is exact. A tile of anchors against rows
is one matrix product: Strassen's recursion on 64-bit integers, halves padded with zeros to even
sizes, sums and differences of blocks exact. What wraps around in between cancels out, because the
true scores fit in 64 bits.

A tile leaves at most ``n`` rows per anchor: heaps of the best scores, ties by the smaller vec_id.
Heaps merge: the best of two tiles' heaps are the best of both tiles. They merge inside a task, tile
by tile, and then between tasks by rank in Spark, which keeps a partial top-n before its shuffle.

First the positives: rows are dealt to buckets by label, and a bucket to blocks by hash, so a label
with a third of all rows is many groups. Then the windows that the positives' scores open, one heap
for each anchor and positive: all anchors meet all rows, in (anchor block, row block) groups. A group
holds about ``ANCHORS`` anchors and ``MEMBERS`` rows, however large the table is.

Cases: rows with a null label, a null vector, or any null or non-finite component take no part, nor
do rows without a vec_id, which could not be named, or with a norm beyond ``NORM2``, whose scores
would not fit in 64 bits. Vectors of different lengths are padded with zeros; an empty vector scores
0 with all. Repeated rows and ids are rows of their own: a copy of an anchor is one of its "other"
rows. Anchors without a positive, and positives whose window is empty, have no rows; a table without
anchors gives an empty result. Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_and_read

SCALE, EVERY = 256, 50
POSITIVES, NEGATIVES = 5, 3
NORM2 = 2.0**56  # of a row: 95 times a score fits in 63 bits
ANCHORS, MEMBERS = 2048, 8192  # of a group, about
TILE_ANCHORS, TILE_MEMBERS = 512, 2048
LEAF = 16
_NONE = np.iinfo(np.int64).min


def rows_of(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label, v (array of int): the rows that take part."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("double"))
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    norm2 = F.aggregate(F.transform("embedding", lambda c: F.pow(c.cast("double") * F.lit(float(scale)), 2.0)), F.lit(0.0), lambda a, c: a + c)
    usable = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite).filter(norm2 <= NORM2)
    return usable.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform(x, lambda c: c.cast("int")).alias("v"))


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A plain product; in doubles where all its sums are below 2^53, so exact either way."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(a: np.ndarray) -> np.ndarray:
    n, m = a.shape
    return np.pad(a, ((0, n % 2), (0, m % 2))) if n % 2 or m % 2 else a


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of 64-bit integers: seven products of halves instead of eight."""
    n, m = a.shape[0], b.shape[1]
    if min(n, a.shape[1], m) <= leaf:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), np.int64)
    out[:i, :k], out[:i, k:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :k], out[i:, k:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:n, :m]


class Heaps:
    """The best scores of each anchor with their places; places come in ascending order, so the
    earlier of equal scores is kept."""

    def __init__(self, anchors: int, size: int):
        self.score, self.place = np.full((anchors, size), _NONE, np.int64), np.full((anchors, size), -1, np.int64)

    def offer(self, scores: np.ndarray, start: int) -> None:
        """Scores of the next places (columns); ``_NONE`` is none. Changes ``scores``."""
        size = self.score.shape[1]
        rows = np.flatnonzero(scores.max(axis=1, initial=_NONE) > self.score[:, -1])
        if not len(rows):
            return
        left, at = scores[rows], np.arange(len(rows))
        found, places = np.full((len(rows), size), _NONE, np.int64), np.full((len(rows), size), -1, np.int64)
        for i in range(min(size, left.shape[1])):
            top = left.argmax(axis=1)  # the first of equal ones
            found[:, i], places[:, i] = left[at, top], start + top
            left[at, top] = _NONE
        both, where = np.concatenate((self.score[rows], found), 1), np.concatenate((self.place[rows], places), 1)
        order = np.argsort(~both, axis=1, kind="stable")[:, :size]
        self.score[rows], self.place[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of 64-bit integers, padded with zeros."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = lists.flatten().to_numpy()
    return out


def _tiles(left: pa.Table, right: pa.Table):
    """Scores of anchors (left) against rows (right), tile by tile: the anchors' and rows' slices, and the scores."""
    width = max(int(t["v"].combine_chunks().value_lengths().to_numpy().max(initial=0)) for t in (left, right))
    x, y = _matrix(left["v"], width), np.ascontiguousarray(_matrix(right["v"], width).T)
    for a in range(0, len(x), TILE_ANCHORS):
        for m in range(0, y.shape[1], TILE_MEMBERS):
            yield slice(a, a + TILE_ANCHORS), slice(m, m + TILE_MEMBERS), strassen(x[a:a + TILE_ANCHORS], y[:, m:m + TILE_MEMBERS])


_POSITIVE = "anchor long, score long, vec_id long, row long"
_NEGATIVE = "anchor long, slot int, score long, vec_id long"


def _heap_rows(heaps: Heaps, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all entries: the anchors' places, the scores, the rows' places."""
    a, i = np.nonzero(heaps.place >= 0)
    return a, heaps.score[a, i], heaps.place[a, i]


def _positives(left: pa.Table, right: pa.Table) -> pa.Table:
    """Heaps of the best rows of the anchor's own label, of one group."""
    if not left.num_rows or not right.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in ("anchor", "score", "vec_id", "row")})
    right = right.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    own, row = left["row"].to_numpy(), right["row"].to_numpy()
    own_label, label = left["label"].to_numpy(), right["label"].to_numpy()
    heaps = Heaps(left.num_rows, POSITIVES)
    for a, m, s in _tiles(left, right):
        part = Heaps(0, POSITIVES)
        part.score, part.place = heaps.score[a], heaps.place[a]
        part.offer(np.where((own_label[a, None] == label[None, m]) & (own[a, None] != row[None, m]), s, _NONE), m.start)
    a, score, place = _heap_rows(heaps, right)
    return pa.table({"anchor": own[a], "score": score, "vec_id": right["vec_id"].to_numpy()[place], "row": row[place]})


def _negatives(left: pa.Table, right: pa.Table) -> pa.Table:
    """Heaps of the best rows of other labels in the window of each of the anchor's positives."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"anchor": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64())})
    right = right.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    own, own_label, label = left["row"].to_numpy(), left["label"].to_numpy(), right["label"].to_numpy()
    lists = left["scores"].combine_chunks()
    open_ = np.arange(POSITIVES)[None, :] < lists.value_lengths().to_numpy()[:, None]
    score = np.zeros(open_.shape, np.int64)
    score[open_] = lists.flatten().to_numpy()
    # 50 * positive <= 100 * negative <= 95 * positive; a slot without a positive has an empty window
    low, high = np.where(open_, -(-score // 2), 1), np.where(open_, 19 * score // 20, 0)
    heaps = [Heaps(left.num_rows, NEGATIVES) for _ in range(POSITIVES)]
    for a, m, s in _tiles(left, right):
        s[own_label[a, None] == label[None, m]] = _NONE
        for slot, heap in enumerate(heaps):
            part = Heaps(0, NEGATIVES)
            part.score, part.place = heap.score[a], heap.place[a]
            part.offer(np.where((s >= low[a, slot, None]) & (s <= high[a, slot, None]), s, _NONE), m.start)
    found = [_heap_rows(h, right) for h in heaps]
    slots = np.concatenate([np.full(len(f[0]), i, np.int32) for i, f in enumerate(found)])
    at, scores, place = (np.concatenate([f[i] for f in found]) for i in range(3))
    return pa.table({"anchor": own[at], "slot": slots, "score": scores, "vec_id": right["vec_id"].to_numpy()[place]})


def _dealt(blocks):
    """A row's own block, and all blocks of the other side: it meets each row of that side once."""
    return F.pmod(F.xxhash64("row", F.lit("block")), blocks), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _groups(anchors: DataFrame, rows: DataFrame, sizes: DataFrame | None, a_blocks, m_blocks) -> tuple[DataFrame, DataFrame]:
    """Anchors and rows dealt to (anchor block, row block) groups, of each bucket if ``sizes`` has buckets."""
    if sizes is not None:
        anchors, rows = anchors.join(sizes, "bucket"), rows.join(sizes, "bucket")
    (own, every), (member, _) = _dealt(a_blocks), _dealt(m_blocks)
    a = anchors.withColumn("a_block", own).withColumn("m_block", every(m_blocks))
    m = rows.withColumn("m_block", member).withColumn("a_block", every(a_blocks))
    a, m = a.drop("a_blocks", "m_blocks"), m.drop("a_blocks", "m_blocks")
    return a, m.toDF(*m.columns)  # columns of its own: both may come from one table


def mine(vectors: DataFrame, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = write_and_read(rows_of(vectors, scale), "negatives-rows")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    # positives: rows of the anchor's label
    blocks = lambda of: F.ceil(F.count("*") / of)
    n_members = max(1, rows.agg(blocks(MEMBERS).alias("n")).first()["n"])
    bucket = F.pmod(F.xxhash64("label"), F.lit(n_members))
    labelled, of_labels = anchors.withColumn("bucket", bucket), rows.withColumn("bucket", bucket)
    sizes = labelled.groupBy("bucket").agg(blocks(ANCHORS).alias("a_blocks")).join(of_labels.groupBy("bucket").agg(blocks(MEMBERS).alias("m_blocks")), "bucket")
    a, m = _groups(labelled, of_labels, sizes, F.col("a_blocks"), F.col("m_blocks"))
    key = ["bucket", "a_block", "m_block"]
    heaps = a.groupBy(*key).cogroup(m.groupBy(*key)).applyInArrow(_positives, _POSITIVE)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    heaps = heaps.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= POSITIVES)
    positives = write_and_read(heaps.select("anchor", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # negatives: rows of other labels, in the windows of the positives
    scores = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    opened = anchors.join(scores, F.col("row") == F.col("anchor")).select("row", "label", "v", "scores")
    n_anchors = max(1, anchors.agg(blocks(ANCHORS).alias("n")).first()["n"])
    a, m = _groups(opened, rows, None, F.lit(n_anchors), F.lit(n_members))
    key = ["a_block", "m_block"]
    found = a.groupBy(*key).cogroup(m.groupBy(*key)).applyInArrow(_negatives, _NEGATIVE)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEGATIVES)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(positives, ["anchor", "slot"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's labels: where vec_id is divisible by 7, (label + 1) % 10."""
    label = F.col("label").cast("long")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return mine(relabelled(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))


ORACLE_SQL = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
score AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM part a JOIN part r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM score WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
       p.positive_score, s.score AS negative_score
FROM positive p JOIN score s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""
