"""Views and joined read models.

Joins are plain equi-joins; Catalyst/AQE choose the strategy from sizes
(the plans table becomes a broadcast only when it is measured small).
Child lists are aggregated per parent before they meet, so a user with
many subscriptions and payments never multiplies the two lists."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lit_ts
from ..sources import schemas as S


def active_subscriptions(subscriptions: DataFrame, users: DataFrame, plans: DataFrame) -> DataFrame:
    """vw_ActiveSubscriptions: status Active only (no date test)."""
    s = subscriptions.where(F.col("status") == "Active").select(
        "subscription_id", "user_id", "plan_id", "start_date", "end_date", "auto_renew")
    u = users.select("user_id", "first_name", "last_name", "email")
    p = plans.select("plan_id", F.col("name").alias("plan_name"), "billing_cycle")
    return s.join(u, "user_id").join(p, "plan_id").select(
        "subscription_id", "user_id", "first_name", "last_name", "email", "plan_id", "plan_name",
        "billing_cycle", "start_date", "end_date", "auto_renew")


def user_payment_history(users: DataFrame, subscriptions: DataFrame, payments: DataFrame,
                         plans: DataFrame) -> DataFrame:
    """vw_UserPaymentHistory: every payment with its user and plan.

    The subscription side (smaller than payments) is enriched with user and
    plan first, so the payment-sized data is shuffled once, for one join."""
    u = users.select("user_id", "first_name", "last_name", "email")
    s = subscriptions.select("subscription_id", "user_id", "plan_id")
    pm = payments.select("payment_id", "subscription_id", "amount", "payment_date", "payment_method",
                         "transaction_id", F.col("status").alias("payment_status"))
    pl = plans.select("plan_id", F.col("name").alias("plan_name"))
    enriched = s.join(u, "user_id").join(pl, "plan_id")
    return (pm.join(enriched, "subscription_id")
            .select("user_id", "first_name", "last_name", "email", "subscription_id", "payment_id", "amount",
                    "payment_date", "payment_method", "transaction_id", "payment_status", "plan_id", "plan_name"))


def user_subscriptions(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Each user's subscriptions with the plan name, newest start first."""
    pl = plans.select("plan_id", F.col("name").alias("plan_name"))
    return (subscriptions.join(pl, "plan_id")
            .select("subscription_id", "user_id", "plan_id", "start_date", "end_date", "renewal_date",
                    "status", "auto_renew", "plan_name")
            .orderBy("user_id", F.desc("start_date"), "subscription_id"))


def user_payments(payments: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each user's payments (through their subscriptions), newest first."""
    s = subscriptions.select("subscription_id", "user_id")
    return (payments.join(s, "subscription_id")
            .select("user_id", "payment_id", "subscription_id", "amount", "payment_date",
                    "payment_method", "transaction_id", "status")
            .orderBy("user_id", F.desc("payment_date"), F.desc("payment_id")))


def latest_completed_payment(payments: DataFrame) -> DataFrame:
    """Latest Completed payment per subscription (payment id breaks date ties).

    ``max_by`` over one numeric key - microseconds since the epoch (counted
    on the NTZ value, so no time zone enters) times 10^19 (more than any 64-bit id) plus the payment
    id - is a partial hash aggregate: each map task keeps one row per
    subscription, so a subscription with very many payments costs no more
    shuffle than one with a single payment, and no partition is sorted."""
    key = (F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("payment_date"))
           .cast("decimal(18,0)") * F.lit(Decimal(10) ** 19) + F.col("payment_id")).cast("decimal(38,0)")
    p = payments.where(F.col("status") == "Completed").withColumn("_k", key)
    return p.groupBy("subscription_id").agg(
        F.max_by("payment_id", "_k").alias("payment_id"), F.max_by("amount", "_k").alias("amount"),
        F.max_by("payment_date", "_k").alias("payment_date"))


def user_360(users: DataFrame, subscriptions: DataFrame, payments: DataFrame, as_of) -> DataFrame:
    """One row per user: profile, subscription counts by status, payment
    counts and sums, and the latest subscription and payment.

    Payments are first reduced per subscription, then subscriptions (with
    their payment summaries) per user: no fan-out join of the two lists."""
    pay_per_sub = payments.groupBy("subscription_id").agg(
        F.count(F.lit(1)).alias("n_pay"),
        F.sum(F.when(F.col("status") == "Completed", F.col("amount")).otherwise(F.lit(0))).alias("paid"),
        F.sum(F.when(F.col("status") == "Refunded", F.col("amount")).otherwise(F.lit(0))).alias("refunded"),
        F.max("payment_date").alias("last_pay"))
    s = subscriptions.select("subscription_id", "user_id", "status", "start_date", "end_date")
    s = s.join(pay_per_sub, "subscription_id", "left")
    is_active = (F.col("status") == "Active") & (F.col("end_date") > lit_ts(as_of))
    per_user = s.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("subscription_count"),
        F.sum(F.when(F.col("status") == "Active", 1).otherwise(0)).cast("bigint").alias("active_status_count"),
        F.sum(F.when(is_active, 1).otherwise(0)).cast("bigint").alias("active_now_count"),
        F.sum(F.when(F.col("status") == "Cancelled", 1).otherwise(0)).cast("bigint").alias("cancelled_count"),
        F.coalesce(F.sum("n_pay"), F.lit(0)).cast("bigint").alias("payment_count"),
        F.coalesce(F.sum("paid"), F.lit(0)).cast(S.TOTAL).alias("completed_total"),
        F.coalesce(F.sum("refunded"), F.lit(0)).cast(S.TOTAL).alias("refunded_total"),
        F.max("start_date").alias("last_start_date"),
        F.max("last_pay").alias("last_payment_date"))
    u = users.select("user_id", "first_name", "last_name", "email", "role", "registration_date")
    out = u.join(per_user, "user_id", "left")
    zero = {c: 0 for c in ["subscription_count", "active_status_count", "active_now_count",
                          "cancelled_count", "payment_count"]}
    out = out.fillna(zero)
    return out.select(
        "user_id", "first_name", "last_name", "email", "role", "registration_date",
        F.col("subscription_count").cast("bigint").alias("subscription_count"),
        "active_status_count", "active_now_count", "cancelled_count", "payment_count",
        F.coalesce("completed_total", F.lit(0).cast(S.TOTAL)).alias("completed_total"),
        F.coalesce("refunded_total", F.lit(0).cast(S.TOTAL)).alias("refunded_total"),
        "last_start_date", "last_payment_date")


def subscription_actions(subscriptions: DataFrame) -> DataFrame:
    """Allowed actions: Active -> Renew, Cancel; Expired -> Renew; else none."""
    acts = (F.when(F.col("status") == "Active", F.array(F.lit("Renew"), F.lit("Cancel")))
            .when(F.col("status") == "Expired", F.array(F.lit("Renew")))
            .otherwise(F.array().cast("array<string>")))
    return subscriptions.select("subscription_id", "status", F.array_join(acts, ",").alias("actions"))


def payments_refundable(payments: DataFrame) -> DataFrame:
    return payments.select("payment_id", "status", (F.col("status") == "Completed").alias("refundable"))
