"""Subscription change jobs: subscribe (C8), renew (C9), cancel (C10),
expire due (C13), set status (C14), default end date (C17).

Commands are validated by left joins against the snapshots (one join per
referenced table, never per command), split into accepted and rejected,
and every output is derived from the same accepted set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions.dates import add_days, lit_ts, remaining_days, renewal_end
from ..functions.text import TEMPLATES, date_text, render
from ..session import checkpoint_dir
from ..sources import schemas as S
from . import ids
from .changes import ChangeSet, first_failure, log_rows, notification_rows, txn_id
from .views import latest_completed_payment

# Notification subjects of the reference (message texts are
# in functions.text.TEMPLATES).
SUBSCRIBED_SUBJECT = "Subscription Confirmed"
RENEWED_SUBJECT = "Subscription Renewed"
CANCELLED_SUBJECT = "Subscription Cancelled"
EXPIRED_SUBJECT = "Subscription Expired"


def _plans_info(plans: DataFrame) -> DataFrame:
    return plans.select("plan_id", F.col("name").alias("plan_name"), "price", "duration_days")


def subscribe(users: DataFrame, plans: DataFrame, subscriptions: DataFrame, payments: DataFrame,
              cmds: DataFrame, as_of) -> ChangeSet:
    """New Active subscription + Completed payment of the plan price per accepted command."""
    u = users.select("user_id", F.col("role").alias("_role"), F.lit(True).alias("_user"))
    p = _plans_info(plans).withColumn("_plan", F.lit(True))
    j = cmds.join(u, "user_id", "left").join(p, "plan_id", "left")
    reason = first_failure(
        (F.col("_user").isNull(), "user_not_found"),
        (F.lower(F.col("_role")) == "admin", "admin_cannot_subscribe"),
        (F.col("_plan").isNull(), "plan_not_found"))
    checkpoint_dir(j.sparkSession)
    j = j.withColumn("reason", reason).checkpoint(eager=True)
    ok = j.where(F.col("reason").isNull())
    ok = ids.assign_ids(ok, ["seq"], ids.max_id(subscriptions, "subscription_id"), "subscription_id")
    ok = ok.withColumn("payment_id", (F.col("subscription_id") - ids.max_id(subscriptions, "subscription_id")
                                      + F.coalesce(ids.max_id(payments, "payment_id"), F.lit(0))).cast("bigint"))
    ok = ok.withColumn("end_date", add_days(lit_ts(as_of), F.col("duration_days")))
    new_subs = ok.select("subscription_id", "user_id", "plan_id", lit_ts(as_of).alias("start_date"), "end_date",
                         F.lit(None).cast(S.TS).alias("renewal_date"), F.lit("Active").alias("status"), "auto_renew")
    new_pays = ok.select("payment_id", "subscription_id", F.col("price").alias("amount"),
                         lit_ts(as_of).alias("payment_date"), "payment_method",
                         txn_id("subscribe", F.col("seq"), as_of).alias("transaction_id"), F.lit("Completed").alias("status"))
    logs = log_rows(ok, F.col("user_id"), "SubscriptionCreated",
                    render(TEMPLATES["subscribed_log"], user_id="user_id", plan_name="plan_name", plan_id="plan_id",
                           subscription_id="subscription_id"), as_of
                    ).unionByName(log_rows(ok, F.col("user_id"), "PaymentProcessed",
                    render(TEMPLATES["subscribed_payment_log"], payment_id="payment_id", subscription_id="subscription_id",
                           amount=M.currency_inr(F.col("price"))), as_of))
    notes = notification_rows(ok, F.col("user_id"), SUBSCRIBED_SUBJECT,
                              render(TEMPLATES["subscribed_body"], subscription_id="subscription_id",
                                     plan_name="plan_name"), as_of)
    rejected = j.where(F.col("reason").isNotNull()).select(
        "seq", "user_id", "plan_id", "reason", F.lit(None).cast("bigint").alias("subscription_id"),
        F.lit(None).cast("bigint").alias("payment_id"), F.lit(None).cast(S.TS).alias("end_date"),
        F.lit(None).cast(S.MONEY).alias("amount"))
    accepted = ok.select("seq", "user_id", "plan_id", F.lit(None).cast("string").alias("reason"), "subscription_id",
                         "payment_id", "end_date", F.col("price").alias("amount"))
    outcome = accepted.unionByName(rejected).withColumn("accepted", F.col("reason").isNull())
    return ChangeSet(outcome, {"subscriptions": new_subs, "payments": new_pays}, logs=logs, notifications=notes)


def renew(subscriptions: DataFrame, plans: DataFrame, payments: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """Renew: end = max(end, as_of) + k x duration after the k-th accepted
    renewal of a subscription in the batch; Active; renewal date as_of; one
    payment of the plan price per renewal."""
    s_ = subscriptions.select("subscription_id", F.col("user_id").alias("_owner"), "plan_id",
                              F.col("end_date").alias("_end"), F.col("status").alias("_status"))
    j = cmds.join(s_, "subscription_id", "left").join(_plans_info(plans), "plan_id", "left")
    reason = first_failure(
        (F.col("_owner").isNull(), "not_found"),
        (F.col("_owner") != F.col("user_id"), "not_owner"),
        (F.col("_status") == "Cancelled", "cancelled"))
    j = j.withColumn("reason", reason)
    ok = ids.rank_within(j.where(F.col("reason").isNull()), ["subscription_id"], ["seq"], "k")
    ok = ids.assign_ids(ok, ["seq"], ids.max_id(payments, "payment_id"), "payment_id")
    ok = ok.withColumn("new_end", renewal_end(F.col("_end"), as_of, F.col("duration_days"), F.col("k")))
    last = ok.groupBy("subscription_id").agg(F.max("k").alias("k"))
    final = ok.join(last, ["subscription_id", "k"])
    changed = (subscriptions.join(final.select("subscription_id", "new_end"), "subscription_id")
               .withColumn("end_date", F.col("new_end")).withColumn("renewal_date", lit_ts(as_of))
               .withColumn("status", F.lit("Active")).select(*subscriptions.columns))
    new_pays = ok.select("payment_id", "subscription_id", F.col("price").alias("amount"),
                         lit_ts(as_of).alias("payment_date"), "payment_method",
                         txn_id("renew", F.col("seq"), as_of).alias("transaction_id"), F.lit("Completed").alias("status"))
    logs = log_rows(ok, F.col("user_id"), "SubscriptionRenewed",
                    render(TEMPLATES["renewed_log"], subscription_id="subscription_id",
                           new_end=date_text(F.col("new_end")), plan_name="plan_name"), as_of)
    notes = notification_rows(ok, F.col("user_id"), RENEWED_SUBJECT,
                              render(TEMPLATES["renewed_body"], subscription_id="subscription_id",
                                     new_end=date_text(F.col("new_end"))), as_of)
    outcome = (ok.select("seq", "subscription_id", "user_id", F.lit(None).cast("string").alias("reason"),
                         "payment_id", "new_end")
               .unionByName(j.where(F.col("reason").isNotNull()).select(
                   "seq", "subscription_id", "user_id", "reason", F.lit(None).cast("bigint").alias("payment_id"),
                   F.lit(None).cast(S.TS).alias("new_end")))
               .withColumn("accepted", F.col("reason").isNull()))
    return ChangeSet(outcome, {"subscriptions": changed, "payments": new_pays}, logs=logs, notifications=notes)


def cancel(subscriptions: DataFrame, plans: DataFrame, payments: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """Cancel Active subscriptions of the right owner: Cancelled, end = as_of,
    no auto-renew; pro-rata refund of the price for the days left; the latest
    Completed payment becomes Refunded when the refund is positive."""
    s_ = subscriptions.select("subscription_id", F.col("user_id").alias("_owner"), "plan_id",
                              F.col("end_date").alias("_end"), F.col("status").alias("_status"))
    j = cmds.join(s_, "subscription_id", "left").join(_plans_info(plans), "plan_id", "left")
    # a later cancel of the same subscription finds it already cancelled: the
    # first one is found by a min aggregate and flagged by a join on the
    # unique seq, so a subscription with very many commands is no hot join key
    first = (j.where(F.col("_owner") == F.col("user_id")).groupBy("subscription_id")
             .agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first")))
    j = j.join(first, "seq", "left")
    reason = first_failure(
        (F.col("_owner").isNull(), "not_found"),
        (F.col("_owner") != F.col("user_id"), "not_owner"),
        (F.col("_status") != "Active", "not_active"),
        (F.col("_first").isNull(), "not_active"))
    j = j.withColumn("reason", reason)
    rem = remaining_days(F.col("_end"), as_of, F.col("duration_days"))
    ok = (j.where(F.col("reason").isNull()).withColumn("remaining_days", rem)
          .withColumn("refund_amount", M.prorata(F.col("price"), F.col("remaining_days"), F.col("duration_days"))))
    # only the payments of the subscriptions being cancelled are ranked, for
    # the outputs that name one: each cancelled subscription has one row in ok
    # and at most one latest payment, so the others don't wait for payments
    mine = payments.join(ok.select("subscription_id").distinct(), "subscription_id", "left_semi")
    latest = latest_completed_payment(mine).select("subscription_id", F.col("payment_id").alias("refunded_payment_id"))
    paid = ok.join(latest, "subscription_id", "left").withColumn(
        "refunded_payment_id", F.when(F.col("refund_amount") > 0, F.col("refunded_payment_id")))
    changed_subs = (subscriptions.join(ok.select("subscription_id"), "subscription_id")
                    .withColumn("status", F.lit("Cancelled")).withColumn("end_date", lit_ts(as_of))
                    .withColumn("auto_renew", F.lit(False)).select(*subscriptions.columns))
    changed_pays = (payments.join(paid.where(F.col("refunded_payment_id").isNotNull())
                                  .select(F.col("refunded_payment_id").alias("payment_id")), "payment_id")
                    .withColumn("status", F.lit("Refunded")).select(*payments.columns))
    refund_text = M.currency_inr(F.col("refund_amount"))
    logs = log_rows(ok, F.col("user_id"), "SubscriptionCancelled",
                    render(TEMPLATES["cancelled_log"], subscription_id="subscription_id", refund=refund_text,
                           plan_name="plan_name"), as_of)
    notes = notification_rows(ok, F.col("user_id"), CANCELLED_SUBJECT,
                              render(TEMPLATES["cancelled_body"], subscription_id="subscription_id", refund=refund_text),
                              as_of)
    outcome = (paid.select("seq", "subscription_id", "user_id", F.lit(None).cast("string").alias("reason"),
                           "remaining_days", "refund_amount", "refunded_payment_id")
               .unionByName(j.where(F.col("reason").isNotNull()).select(
                   "seq", "subscription_id", "user_id", "reason", F.lit(None).cast("int").alias("remaining_days"),
                   F.lit(None).cast(S.TOTAL).alias("refund_amount"), F.lit(None).cast("bigint").alias("refunded_payment_id")))
               .withColumn("accepted", F.col("reason").isNull()))
    return ChangeSet(outcome, {"subscriptions": changed_subs, "payments": changed_pays}, logs=logs, notifications=notes)


def expire_due(subscriptions: DataFrame, as_of) -> ChangeSet:
    """Active with end <= as_of become Expired; one log and one notification
    each; re-running on the result changes nothing."""
    due = subscriptions.where((F.col("status") == "Active") & (F.col("end_date") <= lit_ts(as_of)))
    changed = due.withColumn("status", F.lit("Expired")).select(*subscriptions.columns)
    logs = log_rows(due, F.col("user_id"), "SubscriptionExpired",
                    render(TEMPLATES["expired_log"], subscription_id="subscription_id"), as_of, keep=["subscription_id"])
    notes = notification_rows(due, F.col("user_id"), EXPIRED_SUBJECT,
                              render(TEMPLATES["expired_body"], subscription_id="subscription_id"),
                              as_of, keep=["subscription_id"])
    outcome = due.select("subscription_id", "user_id", "plan_id", "end_date", F.lit(True).alias("accepted"))
    return ChangeSet(outcome, {"subscriptions": changed}, logs=logs, notifications=notes)


def expiry_run_log(subscriptions: DataFrame, as_of) -> DataFrame:
    """ST4: the ExpiryCheckRan log row with the number expired."""
    n = subscriptions.where((F.col("status") == "Active") & (F.col("end_date") <= lit_ts(as_of)))
    stamp = F.concat(F.date_format(lit_ts(as_of), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    return n.agg(F.count(F.lit(1)).alias("expired_count")).select(
        F.lit(None).cast("bigint").alias("user_id"), F.lit("ExpiryCheckRan").alias("action"),
        render(TEMPLATES["expiry_run_log"], count="expired_count", stamp=stamp).alias("message"),
        "expired_count")


def set_status(subscriptions: DataFrame, cmds: DataFrame) -> ChangeSet:
    """sp_UpdateSubscriptionStatus in bulk: invalid values are rejected; an
    unknown id updates nothing. The last valid command per id wins."""
    s_ = subscriptions.select("subscription_id", F.col("status").alias("old_status"))
    j = cmds.join(s_, "subscription_id", "left")
    reason = first_failure((~F.col("new_status").isin(*S.SUBSCRIPTION_STATUSES), "invalid_status"),
                           (F.col("old_status").isNull(), "not_found"))
    j = j.withColumn("reason", reason)
    ok = j.where(F.col("reason").isNull())
    # the status's position (an int) keeps max_by a hash aggregate
    names = F.array(*[F.lit(x) for x in S.SUBSCRIPTION_STATUSES])
    last = (ok.withColumn("_code", F.array_position(names, F.col("new_status")).cast("int"))
            .groupBy("subscription_id").agg(F.max_by("_code", "seq").alias("_new")))
    changed = (subscriptions.join(last, "subscription_id")
               .withColumn("status", F.element_at(names, F.col("_new"))).select(*subscriptions.columns))
    outcome = j.select("seq", "subscription_id", "old_status", "new_status", "reason",
                       F.col("reason").isNull().alias("accepted"))
    return ChangeSet(outcome, {"subscriptions": changed})


def default_end_date(incoming: DataFrame, plans: DataFrame) -> DataFrame:
    """C17: end date = start + plan duration where it is missing."""
    d = plans.select("plan_id", F.col("duration_days").alias("_dur"))
    return (incoming.join(d, "plan_id", "left")
            .withColumn("end_date", F.coalesce(F.col("end_date"), add_days(F.col("start_date"), F.col("_dur"))))
            .drop("_dur"))


def mixed(subscriptions: DataFrame, plans: DataFrame, payments: DataFrame, cmds: DataFrame, as_of) -> ChangeSet:
    """Renew and cancel commands for the same subscriptions in one batch,
    with the outcome of serial processing in ``seq`` order.

    The serial state machine has a closed form per subscription, so no
    command list is collected: the subscription turns Active at its first
    renewal (or is Active already); the first cancel after that is the one
    accepted; renewals before it are accepted (the k-th ends at
    max(end, as_of) + k x duration), later renewals find it Cancelled, other
    cancels find it not Active. The refund uses the end date after the
    accepted renewals, and the refunded payment is the latest Completed one
    at that moment - the last renewal payment of the batch when there is one.
    Minimums and ranks per subscription are partial aggregates or range
    positions, never one large group."""
    s_ = subscriptions.select("subscription_id", F.col("user_id").alias("_owner"), "plan_id",
                              F.col("end_date").alias("_end"), F.col("status").alias("_status"))
    j = cmds.join(s_, "subscription_id", "left").join(_plans_info(plans), "plan_id", "left")
    own = F.col("_owner") == F.col("user_id")
    is_renew = F.col("kind") == "renew"
    firsts = (j.where(own & is_renew).groupBy("subscription_id").agg(F.min("seq").alias("_first_renew")))
    j = j.join(firsts, "subscription_id", "left")
    active_from = F.when(F.col("_status") == "Active", F.lit(-1)).otherwise(F.col("_first_renew"))
    cancel_at = (j.where(own & (F.col("kind") == "cancel") & (F.col("_status") != "Cancelled")
                         & active_from.isNotNull() & (F.col("seq") > active_from))
                 .groupBy("subscription_id").agg(F.min("seq").alias("_cancel_seq")))
    j = j.join(cancel_at, "subscription_id", "left")
    after_cancel = F.col("_cancel_seq").isNotNull() & (F.col("seq") > F.col("_cancel_seq"))
    reason = first_failure(
        (F.col("_owner").isNull(), "not_found"),
        (~own, "not_owner"),
        (is_renew & ((F.col("_status") == "Cancelled") | after_cancel), "cancelled"),
        (~is_renew & (F.col("_cancel_seq").isNull() | (F.col("seq") != F.col("_cancel_seq"))), "not_active"))
    # every output below reads the decided commands: write them once
    checkpoint_dir(j.sparkSession)
    j = j.withColumn("reason", reason).checkpoint(eager=True)
    renews = ids.rank_within(j.where(F.col("reason").isNull() & is_renew), ["subscription_id"], ["seq"], "k")
    renews = ids.assign_ids(renews, ["seq"], ids.max_id(payments, "payment_id"), "payment_id")
    renews = renews.withColumn("new_end", renewal_end(F.col("_end"), as_of, F.col("duration_days"), F.col("k")))
    per_sub = renews.groupBy("subscription_id").agg(
        F.struct(F.max_by("new_end", "k").alias("new_end"), F.max_by("payment_id", "k").alias("payment_id")).alias("_last"))
    cancels = (j.where(F.col("reason").isNull() & ~is_renew).join(per_sub, "subscription_id", "left")
               .withColumn("_end_seen", F.coalesce(F.col("_last.new_end"), F.col("_end"))))
    cancels = cancels.withColumn("remaining_days", remaining_days(F.col("_end_seen"), as_of, F.col("duration_days")))
    cancels = cancels.withColumn("refund_amount", M.prorata(F.col("price"), F.col("remaining_days"), F.col("duration_days")))
    mine = payments.join(cancels.select("subscription_id"), "subscription_id", "left_semi")
    latest = latest_completed_payment(mine).select(
        "subscription_id", F.struct(F.col("payment_date").alias("d"), F.col("payment_id").alias("p")).alias("_old"))
    # latest Completed payment when the cancel runs: the newest of the stored
    # ones and the batch's renewal payments (dated as_of), by (date, id)
    renewal = F.when(F.col("_last.payment_id").isNotNull(),
                     F.struct(lit_ts(as_of).alias("d"), F.col("_last.payment_id").alias("p")))
    cancels = cancels.join(latest, "subscription_id", "left").withColumn(
        "refunded_payment_id",
        F.when(F.col("refund_amount") > 0, F.greatest(renewal, F.col("_old"))["p"]))
    # final rows: a cancel wins over renewals (it comes after all accepted ones)
    renewed = per_sub.select("subscription_id", F.col("_last.new_end").alias("_new_end"))
    cancelled = cancels.select("subscription_id", F.lit(True).alias("_cancelled"))
    touched = renewed.join(cancelled, "subscription_id", "full")
    changed_subs = subscriptions.join(touched, "subscription_id").select(
        "subscription_id", "user_id", "plan_id", "start_date",
        F.when(F.col("_cancelled").isNotNull(), lit_ts(as_of)).otherwise(F.col("_new_end")).alias("end_date"),
        F.when(F.col("_new_end").isNotNull(), lit_ts(as_of)).otherwise(F.col("renewal_date")).alias("renewal_date"),
        F.when(F.col("_cancelled").isNotNull(), F.lit("Cancelled")).otherwise(F.lit("Active")).alias("status"),
        F.when(F.col("_cancelled").isNotNull(), F.lit(False)).otherwise(F.col("auto_renew")).alias("auto_renew"))
    new_pays = renews.select("payment_id", "subscription_id", F.col("price").alias("amount"),
                             lit_ts(as_of).alias("payment_date"), "payment_method",
                             txn_id("mixed", F.col("seq"), as_of).alias("transaction_id"), F.lit("Completed").alias("status"))
    refunded = (payments.join(cancels.where(F.col("refunded_payment_id").isNotNull())
                              .select(F.col("refunded_payment_id").alias("payment_id")), "payment_id")
                .withColumn("status", F.lit("Refunded")).select(*payments.columns))
    renewal_refunded = (new_pays.join(cancels.select(F.col("refunded_payment_id").alias("payment_id")), "payment_id", "left_semi")
                        .withColumn("status", F.lit("Refunded")))
    pays_out = new_pays.join(renewal_refunded.select("payment_id"), "payment_id", "left_anti").unionByName(
        renewal_refunded).unionByName(refunded)
    outcome = (renews.select("seq", "kind", "subscription_id", "user_id", F.lit(None).cast("string").alias("reason"),
                             "payment_id", "new_end", F.lit(None).cast(S.TOTAL).alias("refund_amount"),
                             F.lit(None).cast("bigint").alias("refunded_payment_id"))
               .unionByName(cancels.select("seq", "kind", "subscription_id", "user_id",
                                           F.lit(None).cast("string").alias("reason"),
                                           F.lit(None).cast("bigint").alias("payment_id"), F.lit(None).cast(S.TS).alias("new_end"),
                                           "refund_amount", "refunded_payment_id"))
               .unionByName(j.where(F.col("reason").isNotNull()).select(
                   "seq", "kind", "subscription_id", "user_id", "reason", F.lit(None).cast("bigint").alias("payment_id"),
                   F.lit(None).cast(S.TS).alias("new_end"), F.lit(None).cast(S.TOTAL).alias("refund_amount"),
                   F.lit(None).cast("bigint").alias("refunded_payment_id")))
               .withColumn("accepted", F.col("reason").isNull()))
    return ChangeSet(outcome, {"subscriptions": changed_subs, "payments": pays_out})
