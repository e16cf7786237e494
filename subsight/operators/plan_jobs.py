"""Plan change jobs: upsert by name (C1, with C16), update (C2), guarded delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lit_ts
from ..functions.text import TEMPLATES, render
from ..sources import schemas as S
from . import ids
from .changes import ChangeSet, first_failure, last_per, log_rows, with_claims

_VALUES = ["description", "price", "billing_cycle", "duration_days", "features"]


def upsert(plans: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """MERGE by name (case-insensitive): a match updates five columns and
    UpdatedAt, otherwise a new plan with CreatedAt. A name that repeats in
    the batch is one plan: its first command inserts it, later ones update
    it, and the values of the last one stay. Logs PlanCreated either way."""
    tgt = plans.select(F.lower("name").alias("_key"), F.col("plan_id").alias("_match"))
    j = cmds.withColumn("_key", F.lower("name")).join(tgt, "_key", "left")
    fresh = j.where(F.col("_match").isNull())
    firsts = fresh.groupBy("_key").agg(F.min("seq").alias("_first"))
    new = ids.assign_ids(firsts, ["_first"], ids.max_id(plans, "plan_id"), "_new")
    j = j.join(new, "_key", "left").withColumn("plan_id", F.coalesce("_match", "_new"))
    action = F.when(F.col("seq") == F.col("_first"), "inserted").otherwise("updated")
    outcome = j.select("seq", "name", "plan_id", action.alias("action")).withColumn("accepted", F.lit(True))
    # the last command of each plan has its values; joined back on the unique seq
    last = j.groupBy("plan_id").agg(F.max("seq").alias("seq"))
    values = j.join(last.select("seq"), "seq", "left_semi").select(
        "plan_id", F.col("seq").alias("_last"), "_first", *[F.col(c).alias(f"_n_{c}") for c in _VALUES])
    updated = (plans.join(values, "plan_id")
               .select("plan_id", "name", *[F.col(f"_n_{c}").alias(c) for c in _VALUES], "created_at",
                       lit_ts(as_of).alias("updated_at")))
    names = fresh.join(firsts.select(F.col("_first").alias("seq")), "seq", "left_semi").select(F.col("seq").alias("_first"), "name")
    created = values.where(F.col("_first").isNotNull()).join(names, "_first").select(
        "plan_id", "name", *[F.col(f"_n_{c}").alias(c) for c in _VALUES], lit_ts(as_of).alias("created_at"),
        F.when(F.col("_last") != F.col("_first"), lit_ts(as_of)).cast(S.TS).alias("updated_at"))
    cols = plans.columns
    changed = updated.select(*cols).unionByName(created.select(*cols))
    logs = log_rows(outcome, F.lit(None), "PlanCreated",
                    render(TEMPLATES["plan_created_log"], name="name", plan_id="plan_id"), as_of)
    return ChangeSet(outcome, {"plans": changed}, logs=logs)


def update(plans: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """Update by id; rejected when the id is unknown or the name belongs to
    another plan at that moment (case-insensitive; names that earlier commands
    gave up are free, see ``with_claims``). The last accepted command of a plan
    is its row."""
    cur = plans.select("plan_id", F.lit(True).alias("_exists"), "created_at")
    names = plans.select(F.lower("name").alias("_key"), F.col("plan_id").alias("_owner"))
    j = cmds.join(cur, "plan_id", "left").withColumn("_key", F.lower("name"))
    j = with_claims(j, names, "plan_id")
    j = j.withColumn("reason", first_failure((F.col("_exists").isNull(), "not_found"),
                                             (F.col("_clash").isNotNull(), "name_taken")))
    ok = j.where(F.col("reason").isNull())
    changed = last_per(ok, "plan_id").select("plan_id", "name", *_VALUES, "created_at", lit_ts(as_of).alias("updated_at"))
    logs = log_rows(ok, F.lit(None), "PlanUpdated",
                    render(TEMPLATES["plan_updated_log"], name="name", plan_id="plan_id"), as_of)
    outcome = j.select("seq", "plan_id", "name", "reason", F.col("reason").isNull().alias("accepted"))
    return ChangeSet(outcome, {"plans": changed}, logs=logs)


def delete(plans: DataFrame, subscriptions: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """Delete by id unless unknown or referenced by a subscription."""
    cur = plans.select("plan_id", F.lit(True).alias("_exists"))
    used = subscriptions.select("plan_id").distinct().withColumn("_used", F.lit(True))
    j = cmds.join(cur, "plan_id", "left").join(used, "plan_id", "left")
    j = j.withColumn("reason", first_failure((F.col("_exists").isNull(), "not_found"),
                                             (F.col("_used").isNotNull(), "in_use")))
    ok = j.where(F.col("reason").isNull())
    logs = log_rows(ok, F.lit(None), "PlanDeleted",
                    render(TEMPLATES["plan_deleted_log"], plan_id="plan_id"), as_of)
    outcome = j.select("seq", "plan_id", "reason", F.col("reason").isNull().alias("accepted"))
    return ChangeSet(outcome, deletes={"plans": ok.select("plan_id").distinct()}, logs=logs)
