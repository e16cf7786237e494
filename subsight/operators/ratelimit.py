"""Fixed-window rate limiting (ST6) and a skew-proof first-k per group.

A request is admitted when it is among the first ``permits`` requests of
its client in its window (epoch-aligned tumbling windows, arrival order);
excess requests are rejected, never queued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_k(df: DataFrame, group_cols: list[str], order_cols: list[str], k: int, unique_col: str,
            name: str = "admitted", salt_buckets: int = 64, rank: str | None = None) -> DataFrame:
    """Flag the first ``k`` rows of every group in ``order_cols`` order.

    ``row_number() <= k`` lets Spark put a partial top-k (WindowGroupLimit)
    before the shuffle when k is within ``spark.sql.optimizer.
    windowGroupLimitThreshold``: each map task forwards at most k rows per
    group, so a hot group never reaches one task whole. Above that threshold
    the group is first split into ``salt_buckets`` sub-groups by a hash of the
    unique column; each keeps at most k candidates (the first k of the group
    are among them), so the final ranking sees at most k x salt_buckets rows
    per group. Flags return by a join on the unique column, which has no hot
    key."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    rows = df.select(*group_cols, *order_cols, unique_col)
    if k > limit:
        salt = F.pmod(F.xxhash64(F.col(unique_col)), F.lit(salt_buckets))
        sub = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
        rows = (rows.withColumn("_salt", salt).withColumn("_r", F.row_number().over(sub))
                .where(F.col("_r") <= k).drop("_salt", "_r"))
    whole = Window.partitionBy(*group_cols).orderBy(*order_cols)
    keep = (rows.withColumn("_r2", F.row_number().over(whole)).where(F.col("_r2") <= k)
            .select(unique_col, F.lit(True).alias("_in"), "_r2"))
    out = df.join(keep, unique_col, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")
    return out.withColumnRenamed("_r2", rank) if rank else out.drop("_r2")


def window_start(ts: Column, window: str) -> Column:
    """Start of the epoch-aligned window a time falls into; null for no time
    (``F.window`` would drop the row)."""
    micros = F.unix_micros(ts.cast("timestamp"))
    width = F.unix_micros(F.expr(f"TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {window}"))
    return F.timestamp_micros(micros - F.pmod(micros, width)).cast("timestamp_ntz")


def admit(requests: DataFrame, key_col: str, ts_col: str, window: str, permits: int,
          order_cols: list[str], unique_col: str) -> DataFrame:
    """Adds window_start and admitted. Every request gets a decision: one
    without a time belongs to no window and is not admitted."""
    timed = requests.where(F.col(ts_col).isNotNull()).withColumn("window_start", window_start(F.col(ts_col), window))
    out = first_k(timed, [key_col, "window_start"], order_cols, permits, unique_col)
    untimed = requests.where(F.col(ts_col).isNull()).select(
        *requests.columns, F.lit(None).cast("timestamp_ntz").alias("window_start"), F.lit(False).alias("admitted"))
    return out.unionByName(untimed)
