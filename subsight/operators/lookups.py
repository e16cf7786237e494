"""Key lookups, existence tests and reference guards.

A web action that reads one row by id becomes a join of a key DataFrame
against the table: one left join for any number of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(table: DataFrame, keys: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """First match or none per key: ``found`` false and NULL columns for
    unknown keys. Keys are unique in the tables, so a left join is exact."""
    t = table.select(key, *cols, F.lit(True).alias("_hit"))
    return (keys.select(key).join(t, key, "left")
            .select(key, F.coalesce("_hit", F.lit(False)).alias("found"), *cols))


def exists_flag(keys: DataFrame, table: DataFrame, left_key: str, right_key: str | None = None,
                name: str = "exists", case_sensitive: bool = False) -> DataFrame:
    """EXISTS(...) per key, as a left join against the distinct matching keys."""
    right_key = right_key or left_key
    lk, rk = F.col(left_key), F.col(right_key)
    if not case_sensitive:
        lk, rk = F.lower(lk), F.lower(rk)
    hits = table.select(rk.alias("_k")).distinct().withColumn("_hit", F.lit(True))
    k = keys.withColumn("_k", lk)
    return k.join(hits, "_k", "left").drop("_k").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def unreferenced(parent: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents no child refers to (anti join): the rows a guarded delete may remove."""
    return parent.join(children.select(key), key, "left_anti")


def duplicate_groups(df: DataFrame, key_col: str, id_col: str, case_sensitive: bool = False) -> DataFrame:
    """Keys used by more than one row; count and smallest/largest id."""
    k = F.col(key_col) if case_sensitive else F.lower(F.col(key_col))
    return (df.groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("row_count"),
                                           F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"))
            .where(F.col("row_count") > 1))
