"""Mixing sources to target weights (operator 7).

Every document gets a random key (a hash of its id and text), documents are range-sorted by
source and key, a distributed prefix sum of their sizes runs within each source, and each source
is cut at its exact budget. A budget beyond the source's own size repeats whole epochs first.

Only the row number, the source, the size and the key are shuffled, never a text. A source that
holds a third of all rows is spread over many range partitions, because the range bounds include
the key. Per-source totals (one row per source) are the only values on the driver.

Cases: a null source is a source of its own, last in order; a null text has size 0 and takes
nothing; a document of size 0 is taken 0 words; rows that tie in every column get the same key
and are told apart by a row number that is written down first, so reruns agree on the sums;
an empty table gives an empty result. Columns other than ``doc_id``, ``text`` and ``source`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_words, whole_text, write_and_read

WEIGHTS = (5, 2, 1)  # repeated over the sources in code-point order, null last
MAX_EPOCHS = 3
SEED = 20


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.0,
            max_epochs: float = MAX_EPOCHS) -> dict[str | None, float]:
    """The budget of each source: the weights share ``share`` of all sizes; no budget exceeds
    ``max_epochs`` times its source's size, and what is above goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-32-be")))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    left = share * sum(size.values())
    out: dict[str | None, float] = {}
    free = [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > max_epochs * size[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            out[s] = float(max_epochs * size[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def _targets_frame(spark: SparkSession, sized: DataFrame, weights, share, max_epochs) -> DataFrame:
    """One row per source: source_size, target. The driver holds one row per source."""
    totals = [(r["source"], int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    t = targets(totals, weights, share, max_epochs)
    rows = [(s, n, t[s]) for s, n in totals]
    return spark.createDataFrame(rows, "source string, source_size long, target double")


def _key(seed: int):
    """The random place of a document in its source: a hash, the same in every run."""
    return F.xxhash64(F.col("doc_id"), whole_text(), F.lit(seed))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: doc_id) of every document with source, key, size, source_size, target,
    epochs (whole repeats), cut (words of the further, partial repeat; up to the whole document)
    and taken = epochs * size + cut."""
    return _mixed(docs, weights, share, max_epochs, seed, keep or ["doc_id"]).drop("n")


def _mixed(docs: DataFrame, weights, share: float, max_epochs: int, seed: int, keep: list[str]) -> DataFrame:
    """:func:`mix` with ``n``, the number of the row in ``docs``, which orders rows of one key."""
    spark = docs.sparkSession
    text = whole_text()
    sized = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col("source"),
                        count_words(text).alias("size"), _key(seed).alias("key"),
                        F.monotonically_increasing_id().alias("n"))
    # written once: the range bounds and the sums below must see the same rows
    sized = write_and_read(sized, "mix-sizes")
    budget = _targets_frame(spark, sized, weights, share, max_epochs)
    by_range = sized.repartitionByRange("source", "key", "n").select("*", F.spark_partition_id().alias("part"))
    sorted_ = by_range.sortWithinPartitions("source", "key", "n")
    sorted_ = write_and_read(sorted_, "mix-sorted")
    # where each (partition, source) starts: a prefix over one row per partition and source
    # (partition numbers follow the sort order)
    parts = sorted_.groupBy("part", "source").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.col("source").alias("o_source"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part", "source").orderBy("key", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = sorted_.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = (placed.join(offsets.withColumnRenamed("part", "o_part"),
                          (F.col("part") == F.col("o_part")) & F.col("source").eqNullSafe(F.col("o_source")))
              .select("row", "source", "key", "n", "size", (F.col("before") + F.col("offset")).alias("start")))
    b = budget.withColumnRenamed("source", "b_source")
    # the budgets are one row per source, the planner decides how to join them
    out = placed.join(b, F.col("source").eqNullSafe(F.col("b_source")))
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs)
    rest = F.when(F.col("source_size") > 0, words - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0))
    out = out.withColumn("cut", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("long"))
    return out.select("row.*", "source", "key", "size", "source_size", "target", "epochs", "cut",
                      (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), "n")


def repeat(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: each document once per epoch, and once
    more where its further repeat lies in the budget. Documents stay whole here, so the last one
    of a source may reach beyond the budget; a document without words is kept once."""
    mixed = _mixed(docs.select("doc_id", "text", "source"), weights, share, max_epochs, seed, ["doc_id"])
    # the cut of a source is a key and a row number (equal rows share a key): documents up to it are
    # repeated once more. One row per source.
    cuts = mixed.groupBy(F.col("source").alias("m_source")).agg(
        F.max("epochs").alias("m_epochs"), F.max(F.when(F.col("cut") > 0, F.struct("key", "n"))).alias("m_last"))
    whole = docs.select(F.struct(*docs.columns).alias("all"), F.col("source").alias("d_source"),
                        F.struct(_key(seed).alias("key"), F.monotonically_increasing_id().alias("n")).alias("d_key"), (count_words(whole_text()) == 0).alias("d_empty"))
    joined = whole.join(cuts, F.col("d_source").eqNullSafe(F.col("m_source")))
    more = F.when(F.col("d_key") <= F.col("m_last"), 1).otherwise(0)
    copies = F.when(F.col("d_empty"), F.lit(1)).otherwise((F.col("m_epochs") + more).cast("int"))
    return (joined.withColumn("copies", copies).filter("copies > 0")
            .select("all", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("all.*"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
