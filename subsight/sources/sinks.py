"""Sinks: exports, appends and snapshot publishing.

Writes go to the shared folder the cluster names (``spark.checkpoint.dir``
by default); a change job's outputs are written to a new snapshot folder
each and a marker file is written last, so readers see all or nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_quoted, date_text, s

CSV_HEADER = "PlanId,Name,Price,BillingCycle,DurationDays,CreatedAt"


def plans_csv_lines(plans: DataFrame) -> DataFrame:
    """One CSV line per plan: id, quoted name, price, cycle, days, created date."""
    line = F.concat_ws(",", s("plan_id"), csv_quoted(F.col("name")), s("price"), F.col("billing_cycle"),
                       s("duration_days"), date_text(F.col("created_at")))
    return plans.select("plan_id", line.alias("line"))


def write_plans_csv(plans: DataFrame, path: str) -> None:
    """CSV export: each file starts with the header; Name is always quoted,
    with quotes doubled."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition, so of its file
    lines = plans_csv_lines(plans).select(F.when(first, F.concat(F.lit(CSV_HEADER + "\n"), "line")).otherwise(F.col("line")).alias("value"))
    lines.write.mode("errorifexists").text(path)


def json_lines(df: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON object (JSON lines, not one indented array)."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only sink (logs, outbox)."""
    df.write.mode("append").format(fmt).save(path)


def publish(changes, base_path: str) -> dict[str, str]:
    """Write every output of a ChangeSet under ``base_path`` and a _PUBLISHED
    marker last. The outcome is persisted while it is written; every other
    output is evaluated from the commands' decided rows (which jobs that need
    them more than once have checkpointed)."""
    from pyspark import StorageLevel

    out: dict[str, str] = {}
    outcome = changes.outcome.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = {"outcome": outcome}
        parts.update({f"upserts/{k}": v for k, v in changes.upserts.items()})
        parts.update({f"deletes/{k}": v for k, v in changes.deletes.items()})
        for name, df in (("logs", changes.logs), ("notifications", changes.notifications), ("outbox", changes.outbox)):
            if df is not None:
                parts[name] = df
        for name, df in parts.items():
            p = f"{base_path.rstrip('/')}/{name}"
            df.write.mode("errorifexists").parquet(p)
            out[name] = p
        spark = outcome.sparkSession
        spark.createDataFrame([(len(out),)], "outputs int").coalesce(1).write.mode("errorifexists").json(
            f"{base_path.rstrip('/')}/_PUBLISHED")
    finally:
        outcome.unpersist()
    return out


def append_with_ids(target_path: str, base: DataFrame, new_rows: DataFrame, id_col: str,
                    order_cols: list[str], cast: str = "bigint") -> DataFrame:
    """Append ``new_rows`` to the table at ``target_path`` (created from
    ``base`` when absent) with ids continuing the table's largest id, in
    ``order_cols`` order; returns the table as read back."""
    from ..operators import ids

    spark = base.sparkSession
    try:
        current = spark.read.parquet(target_path)
        current.limit(1).count()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        base.write.mode("errorifexists").parquet(target_path)
        current = spark.read.parquet(target_path)
    rows = ids.assign_ids(new_rows, order_cols, ids.max_id(current, id_col), id_col, cast=cast)
    rows.select(*current.columns).write.mode("append").parquet(target_path)
    return spark.read.parquet(target_path)
