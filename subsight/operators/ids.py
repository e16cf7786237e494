"""Identity assignment (C18) and ranks without a single-partition window.

New rows get ``base + 1, base + 2, ...`` in the order of a key. The rows
are range-partitioned and sorted on that key and written with their
partition and place to the shared checkpoint folder, as Parquet, so that
what follows reads only the columns it needs. The position of a row is the number of rows in earlier partitions (one count
per partition - a table with one row per partition, safe to broadcast)
plus its place inside its partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path

_PART_SHIFT = 1 << 33  # monotonically_increasing_id = partition id << 33 | row number


def positions(df: DataFrame, order_cols: list[str], name: str = "_pos") -> DataFrame:
    """Adds ``name`` = 0-based dense position of each row in ``order_cols``
    order (the order columns must be unique together)."""
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    pid = F.spark_partition_id()
    local = F.monotonically_increasing_id() - pid.cast("long") * F.lit(_PART_SHIFT)
    placed = ordered.withColumn("_pid", pid).withColumn("_local", local)
    path = scratch_path(spark, "positions")
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count, not the data
    out = rows.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off")


def assign_ids(df: DataFrame, order_cols: list[str], base: Column, name: str,
               step: int = 1, cast: str = "bigint") -> DataFrame:
    """``name`` = base + (position + 1) * step, in ``order_cols`` order.

    ``base`` is usually ``max(id)`` of the target table as a scalar subquery
    (0 for an empty table)."""
    p = positions(df, order_cols)
    return p.withColumn(name, (F.coalesce(base, F.lit(0)) + (F.col("_pos") + 1) * step).cast(cast)).drop("_pos")


def max_id(table: DataFrame, col: str) -> Column:
    """max(col) of a table as a lazy scalar subquery."""
    return table.agg(F.max(col)).scalar()


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str], name: str = "rank") -> DataFrame:
    """1-based rank of each row inside its group, in ``order_cols`` order.

    Uses global positions and the smallest position per group (a partial
    aggregate), so a group holding most of the rows is still spread over
    many range partitions instead of one window task. When no group has a
    second row (one small aggregate tells), every rank is 1 and the
    positions are not needed."""
    repeated = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    if repeated.limit(1).count() == 0:
        return df.withColumn(name, F.lit(1))
    p = positions(df, group_cols + order_cols)
    first = p.groupBy(*group_cols).agg(F.min("_pos").alias("_first"))
    return (p.join(first, group_cols).withColumn(name, (F.col("_pos") - F.col("_first") + 1).cast("int"))
            .drop("_pos", "_first"))


def running(df: DataFrame, group_cols: list[str], order_col: str, value: str, name: str, how: str) -> DataFrame:
    """Adds ``name``: the ``how`` ("sum" or "max") of ``value`` over the
    earlier rows of the group, in ``order_col`` order (null before the first).

    Rows are range-partitioned on group and order, so a hot group is spread
    over many partitions: a window runs inside each of them, and what earlier
    partitions of the group amount to (one row per group and partition) is
    added."""
    checkpoint_dir(df.sparkSession)
    agg = {"sum": F.sum, "max": F.max}[how]
    fixed = df.repartitionByRange(*group_cols, order_col).checkpoint(eager=True)
    rows = fixed.withColumn("_pid", F.spark_partition_id())
    inside = Window.partitionBy("_pid", *group_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_pid", *group_cols).agg(agg(value).alias("_one"))
    totals = totals.withColumn("_before", agg("_one").over(before)).where(F.col("_before").isNotNull()).drop("_one")
    out = rows.withColumn("_inside", agg(value).over(inside)).join(totals, ["_pid", *group_cols], "left")
    both = F.col("_inside") + F.col("_before") if how == "sum" else F.greatest("_inside", "_before")
    return out.withColumn(name, F.coalesce(both, "_inside", "_before")).drop("_pid", "_inside", "_before")
