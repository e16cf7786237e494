"""Payment change jobs: record payments (C11) and refunds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import money as M
from ..functions.dates import lit_ts, remaining_days
from ..functions.text import TEMPLATES, render
from ..session import checkpoint_dir
from ..sources import schemas as S
from . import ids
from .changes import ChangeSet, first_failure, log_rows, txn_id


def record_payments(subscriptions: DataFrame, payments: DataFrame, outbox: DataFrame, cmds: DataFrame,
                    as_of) -> ChangeSet:
    """New payment + PaymentProcessed log + outbox row per command. A
    command for an unknown subscription is rejected (the foreign key would
    refuse it). The payload carries UserId 0, as the reference writes it."""
    known = subscriptions.select("subscription_id", F.lit(True).alias("_known"))
    j = cmds.join(known, "subscription_id", "left").withColumn(
        "reason", first_failure((F.col("_known").isNull(), "unknown_subscription")))
    ok = ids.assign_ids(j.where(F.col("reason").isNull()), ["seq"], ids.max_id(payments, "payment_id"), "payment_id")
    ok = ok.withColumn("outbox_id", (F.col("payment_id") - ids.max_id(payments, "payment_id")
                                     + F.coalesce(ids.max_id(outbox, "outbox_id"), F.lit(0))).cast("bigint"))
    new_pays = ok.select("payment_id", "subscription_id", "amount", lit_ts(as_of).alias("payment_date"),
                         F.col("method").alias("payment_method"), txn_id("payment", F.col("seq"), as_of).alias("transaction_id"),
                         "status")
    logs = log_rows(ok, F.lit(None), "PaymentProcessed",
                    render(TEMPLATES["payment_recorded_log"], payment_id="payment_id", subscription_id="subscription_id",
                           amount=M.currency_inr(F.col("amount"))), as_of)
    box = ok.select("outbox_id", F.lit("PaymentProcessed").alias("type"),
                    J.outbox_payload(F.lit(0), F.col("subscription_id"), F.col("payment_id"), F.col("amount")).alias("payload"),
                    lit_ts(as_of).alias("created_at"), F.lit(None).cast(S.TS).alias("processed_at"),
                    F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    outcome = (ok.select("seq", "subscription_id", F.lit(None).cast("string").alias("reason"), "payment_id", "outbox_id")
               .unionByName(j.where(F.col("reason").isNotNull()).select(
                   "seq", "subscription_id", "reason", F.lit(None).cast("bigint").alias("payment_id"),
                   F.lit(None).cast("bigint").alias("outbox_id")))
               .withColumn("accepted", F.col("reason").isNull()))
    return ChangeSet(outcome, {"payments": new_pays, "outbox_messages": box}, logs=logs, outbox=box)


def refund(payments: DataFrame, subscriptions: DataFrame, plans: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """Payment -> Refunded; its subscription, when Active, -> Cancelled with
    end = as_of; auto-renew off. The estimate (amount x days left /
    duration) uses the end date as the command found it: after an earlier
    refund in the batch cancelled an Active subscription, no days are left.
    Refunding a Refunded payment is allowed and flagged."""
    pm = payments.select("payment_id", "subscription_id", "amount", F.col("status").alias("payment_status"))
    sb = subscriptions.select("subscription_id", "user_id", F.col("end_date").alias("_end"),
                              F.col("status").alias("sub_status"), "plan_id")
    pl = plans.select("plan_id", F.col("name").alias("plan_name"), "duration_days")
    # subscriptions get their plan first (subscription-sized), then meet the
    # payment-sized commands in one join
    j = cmds.join(pm, "payment_id", "left").join(sb.join(pl, "plan_id", "left"), "subscription_id", "left")
    # the decided commands feed every output: write them once (checkpoint)
    checkpoint_dir(j.sparkSession)
    j = j.withColumn("reason", first_failure((F.col("amount").isNull(), "not_found"))).checkpoint(eager=True)
    ok = j.where(F.col("reason").isNull())
    # first command per subscription and per payment, flagged through the
    # unique seq (min aggregates, no hot join key)
    firsts = ok.groupBy("subscription_id").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first_sub"))
    firstp = ok.groupBy("payment_id").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first_pay"))
    ok = ok.join(firsts, "seq", "left").join(firstp, "seq", "left")
    cut = (F.col("sub_status") == "Active") & F.col("_first_sub").isNull()
    end_seen = F.when(cut, lit_ts(as_of)).otherwise(F.col("_end"))
    ok = ok.withColumn("remaining_days", remaining_days(end_seen, as_of, F.col("duration_days")))
    ok = ok.withColumn("refund_estimate", M.prorata(F.col("amount"), F.col("remaining_days"), F.col("duration_days")))
    ok = ok.withColumn("already_refunded", (F.col("payment_status") == "Refunded") | F.col("_first_pay").isNull())
    changed_pays = (payments.join(ok.select("payment_id").distinct(), "payment_id")
                    .withColumn("status", F.lit("Refunded")).select(*payments.columns))
    # every column decided from the old values (one projection, no chained update)
    touched = ok.select("subscription_id").distinct()
    was_active = F.col("status") == "Active"
    changed_subs = (subscriptions.join(touched, "subscription_id").select(
        "subscription_id", "user_id", "plan_id", "start_date",
        F.when(was_active, lit_ts(as_of)).otherwise(F.col("end_date")).alias("end_date"),
        "renewal_date", F.when(was_active, F.lit("Cancelled")).otherwise(F.col("status")).alias("status"),
        F.lit(False).alias("auto_renew")))
    logs = log_rows(ok, F.col("user_id"), "PaymentRefunded",
                    render(TEMPLATES["payment_refunded_log"], payment_id="payment_id", subscription_id="subscription_id",
                           estimate=M.currency_inr(F.col("refund_estimate")), plan_name="plan_name"), as_of)
    outcome = (ok.select("seq", "payment_id", "subscription_id", F.lit(None).cast("string").alias("reason"),
                         "already_refunded", "sub_status", "remaining_days", "refund_estimate")
               .unionByName(j.where(F.col("reason").isNotNull()).select(
                   "seq", "payment_id", F.lit(None).cast("bigint").alias("subscription_id"), "reason",
                   F.lit(None).cast("boolean").alias("already_refunded"), F.lit(None).cast("string").alias("sub_status"),
                   F.lit(None).cast("int").alias("remaining_days"), F.lit(None).cast(S.TOTAL).alias("refund_estimate")))
               .withColumn("accepted", F.col("reason").isNull()))
    return ChangeSet(outcome, {"payments": changed_pays, "subscriptions": changed_subs}, logs=logs)
