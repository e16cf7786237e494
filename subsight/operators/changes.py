"""Result of a set-based change job and the helpers every job shares.

A job takes table snapshots and a command DataFrame and returns DataFrames:
the outcome per command (accepted or rejected with a reason), the new or
changed rows per table, deleted keys, and the log and notification
messages. Jobs that decide in steps write those to the checkpoint folder;
no table is written until ``sources.sinks.publish`` runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lit_ts
from ..session import scratch_path
from ..sources import schemas as S
from . import ids


@dataclass
class ChangeSet:
    outcome: DataFrame
    upserts: dict[str, DataFrame] = field(default_factory=dict)
    deletes: dict[str, DataFrame] = field(default_factory=dict)
    logs: DataFrame | None = None
    notifications: DataFrame | None = None
    outbox: DataFrame | None = None

    def affected(self) -> DataFrame:
        """Number of accepted commands."""
        return self.outcome.agg(F.sum(F.col("accepted").cast("int")).cast("bigint").alias("affected"))


def first_failure(*checks: tuple[Column, str]) -> Column:
    """Reason of the first failing check, NULL when all pass."""
    out = F.lit(None).cast("string")
    for cond, reason in reversed(checks):
        out = F.when(cond, F.lit(reason)).otherwise(out)
    return out


def log_rows(df: DataFrame, user_id: Column, action: str, message: Column, as_of,
             keep: list[str] | None = None) -> DataFrame:
    """LogMessage rows (user, action, message, timestamp)."""
    return df.select(*(keep or []), user_id.cast("bigint").alias("user_id"), F.lit(action).alias("action"),
                     message.alias("message"), lit_ts(as_of).alias("timestamp_utc"))


def notification_rows(df: DataFrame, user_id: Column, subject: str, body: Column, as_of,
                      keep: list[str] | None = None) -> DataFrame:
    """NotificationMessage rows; Type is always Email in the reference."""
    return df.select(*(keep or []), user_id.cast("bigint").alias("user_id"), F.lit("Email").alias("type"),
                     F.lit(subject).alias("subject"), body.alias("body"), lit_ts(as_of).alias("timestamp_utc"))


def with_claims(cmds: DataFrame, owners: DataFrame, id_col: str) -> DataFrame:
    """Adds ``_clash``: at the command's turn (column seq) its ``_key``, a
    unique name, belongs to another row. A row that takes another name gives
    its old one up (``owners``: _key, _owner; commands with ``_exists``), so
    names can be handed on and swapped within the batch, as in serial replay.

    Whether a command is accepted depends on earlier commands only, so the
    answer is the one fixed point of: accepted, unless another row holds the
    name. It is sought from "all accepted"; each round corrects what follows
    from the round before, so there are as many rounds as the longest cascade
    of refusals. Only names that several rows want, and the commands of those
    rows, take part. A round adds two running aggregates: each row's last
    accepted name, then how many rows hold a name (hot rows and names are
    spread over partitions, see ``ids.running``)."""
    mine = cmds.where(F.col("_exists").isNotNull()).select("seq", F.col(id_col).alias("_id"), "_key")
    held = owners.select(F.lit(None).cast("long").alias("seq"), F.col("_owner").alias("_id"), "_key")
    wanted = mine.unionByName(held).select("_key", "_id").distinct()
    keys = wanted.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("_key", F.lit(True).alias("_contested"))
    rows = wanted.join(keys, "_key", "left_semi").select("_id").distinct()
    events = mine.unionByName(held).join(rows, "_id", "left_semi").join(keys, "_key", "left")
    # a name that a row holds from the start, and one that nobody else wants, is no question
    events = _rewritten(events.select("seq", "_id", "_key", (F.col("seq").isNull() | F.col("_contested").isNull()).alias("_sure"),
                                      F.lit(True).alias("_acc")), "claims")
    while not events.isEmpty():
        last = F.when(F.col("_acc"), F.struct(F.coalesce("seq", F.lit(-(2**63))).alias("at"), "_key"))
        now = ids.running(events.withColumn("_last", last), ["_id"], "seq", "_last", "_prev", "max").withColumn("_prev", F.col("_prev._key"))
        moves = F.col("_acc") & ~F.col("_key").eqNullSafe(F.col("_prev"))
        own = now.select("seq", "_id", "_key", "_sure", "_acc", moves.cast("int").alias("_delta"),
                         F.coalesce(F.col("_prev") == F.col("_key"), F.lit(False)).cast("int").alias("_mine"))
        freed = now.where(moves & F.col("_prev").isNotNull()).select("seq", F.col("_prev").alias("_key"), F.lit(-1).alias("_delta"))
        names = ids.running(own.unionByName(freed, allowMissingColumns=True), ["_key"], "seq", "_delta", "_holders", "sum")
        free = F.coalesce("_holders", F.lit(0)) - F.col("_mine") <= 0
        decided = _rewritten(names.where(F.col("_sure").isNotNull()).select("seq", "_id", "_key", "_sure", (F.col("_sure") | free).alias("_acc"),
                                                                          F.col("_acc").alias("_was")), "claims")
        events = decided.drop("_was")
        if decided.where(F.col("_acc") != F.col("_was")).isEmpty():
            break
    refused = events.where(~F.col("_acc")).select("seq", F.lit(True).alias("_clash"))
    return cmds.join(refused, "seq", "left")


def _rewritten(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: what follows starts from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_per(cmds: DataFrame, id_col: str) -> DataFrame:
    """The last command (largest seq) of each id."""
    last = cmds.groupBy(id_col).agg(F.max("seq").alias("seq")).select("seq")
    return cmds.join(last, "seq", "left_semi")


def apply_upserts(table: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """New snapshot: rows whose key changed are replaced, new keys added."""
    cols = table.columns
    return table.join(changed.select(key), key, "left_anti").select(*cols).unionByName(changed.select(*cols))


def apply_deletes(table: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return table.join(deleted.select(key), key, "left_anti")


def txn_id(prefix: str, seq: Column, batch) -> Column:
    """Deterministic transaction id of a command: reruns agree, and ``batch``
    (its time, or any id of its own) keeps the ids of two batches apart."""
    return F.sha2(F.concat(F.lit(f"{prefix}:{batch}:"), seq.cast("string")), 256)


MONEY = S.MONEY
