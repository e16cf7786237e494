"""User change jobs: register/create (C4), update (C5), guarded delete (C6),
bulk insert (C7). Password hashes are opaque and never leave the job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lit_ts
from ..functions.predicates import blank_col
from ..functions.text import TEMPLATES, render
from . import ids
from .changes import ChangeSet, first_failure, last_per, log_rows, with_claims

USER_VALUES = ["first_name", "last_name", "email", "phone", "address"]


def _email_checks(users: DataFrame, cmds: DataFrame) -> DataFrame:
    """Flags e-mails already registered and repeats of an earlier batch row
    (the first row of the batch wins, as in serial registration)."""
    taken = users.select(F.lower("email").alias("_key")).distinct().withColumn("_taken", F.lit(True))
    c = cmds.withColumn("_key", F.lower("email"))
    # the first row per e-mail, flagged through the unique seq (no hot join key)
    first = c.groupBy("_key").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first"))
    return c.join(taken, "_key", "left").join(first, "seq", "left").drop("_key")


def register(users: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """New users; role as given, Subscriber when blank."""
    j = _email_checks(users, cmds)
    j = j.withColumn("reason", first_failure((F.col("_taken").isNotNull(), "email_taken"),
                                             (F.col("_first").isNull(), "email_taken")))
    ok = ids.assign_ids(j.where(F.col("reason").isNull()), ["seq"], ids.max_id(users, "user_id"), "user_id")
    ok = ok.withColumn("role", F.when(blank_col(F.col("role")), F.lit("Subscriber")).otherwise(F.col("role")))
    new = ok.select("user_id", *USER_VALUES, lit_ts(as_of).alias("registration_date"), "role").select(*users.columns)
    logs = log_rows(ok, F.col("user_id"), "UserRegistered",
                    render(TEMPLATES["user_registered_log"], email="email"), as_of)
    outcome = (ok.select("seq", "email", "user_id", F.lit(None).cast("string").alias("reason"))
               .unionByName(j.where(F.col("reason").isNotNull()).select(
                   "seq", "email", F.lit(None).cast("bigint").alias("user_id"), "reason"))
               .withColumn("accepted", F.col("reason").isNull()))
    return ChangeSet(outcome, {"users": new}, logs=logs)


def bulk_insert(users: DataFrame, rows: DataFrame, as_of) -> DataFrame:
    """sp_BulkInsertUsers: all rows whose e-mail is free (first of the batch
    wins), registration date as_of, new ids in input order."""
    return register(users, rows, as_of).upserts["users"]


def update(users: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """Update profile fields by id; an e-mail that belongs to another user at
    that moment is rejected (one that an earlier command gave up is free, see
    ``with_claims``). The last accepted command of a user is its row."""
    cur = users.select("user_id", F.lit(True).alias("_exists"), "registration_date")
    owners = users.select(F.lower("email").alias("_key"), F.col("user_id").alias("_owner"))
    j = cmds.join(cur, "user_id", "left").withColumn("_key", F.lower("email"))
    j = with_claims(j, owners, "user_id")
    j = j.withColumn("reason", first_failure((F.col("_exists").isNull(), "not_found"),
                                             (F.col("_clash").isNotNull(), "email_taken")))
    ok = j.where(F.col("reason").isNull())
    changed = last_per(ok, "user_id").select("user_id", *USER_VALUES, "registration_date", "role").select(*users.columns)
    logs = log_rows(ok, F.col("user_id"), "UserUpdated", render(TEMPLATES["user_updated_log"], email="email"), as_of)
    outcome = j.select("seq", "user_id", "email", "reason", F.col("reason").isNull().alias("accepted"))
    return ChangeSet(outcome, {"users": changed}, logs=logs)


def delete(users: DataFrame, subscriptions: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """Delete unless unknown or holding subscriptions."""
    cur = users.select("user_id", F.lit(True).alias("_exists"))
    used = subscriptions.select("user_id").distinct().withColumn("_used", F.lit(True))
    j = cmds.join(cur, "user_id", "left").join(used, "user_id", "left")
    j = j.withColumn("reason", first_failure((F.col("_exists").isNull(), "not_found"),
                                             (F.col("_used").isNotNull(), "in_use")))
    ok = j.where(F.col("reason").isNull())
    logs = log_rows(ok, F.col("actor_user_id"), "UserDeleted",
                    render(TEMPLATES["user_deleted_log"], user_id="user_id", actor_user_id="actor_user_id"), as_of)
    outcome = j.select("seq", "user_id", "reason", F.col("reason").isNull().alias("accepted"))
    return ChangeSet(outcome, deletes={"users": ok.select("user_id").distinct()}, logs=logs)
