"""Small hand-checkable seed tables for tests (not a registered query).

Built from the seed rules with ``spark.range`` - no cross join: row n of
the (user, plan) product ordered by (user, plan) is user (n-1) div 10 + 1,
plan (n-1) mod 10 + 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .tables import add_days, ts_ntz

# The ten seed plans (name, price, days, billing cycle).
SEED_PLANS = [
    ("Basic Monthly", "9.99", 30, "Monthly"),
    ("Standard Monthly", "19.99", 30, "Monthly"),
    ("Pro Monthly", "29.99", 30, "Monthly"),
    ("Basic Yearly", "99.00", 365, "Yearly"),
    ("Standard Yearly", "199.00", 365, "Yearly"),
    ("Pro Yearly", "299.00", 365, "Yearly"),
    ("Team Monthly", "49.99", 30, "Monthly"),
    ("Team Yearly", "499.00", 365, "Yearly"),
    ("Enterprise Monthly", "99.99", 30, "Monthly"),
    ("Enterprise Yearly", "999.00", 365, "Yearly"),
]
# Seed log actions, first match of n mod 6, 5, 4, 3, 2, else the last.
SEED_LOG_ACTIONS = [(6, "PaymentProcessed"), (5, "SubscriptionCancelled"), (4, "SubscriptionRenewed"),
                    (3, "SubscriptionCreated"), (2, "UserLogin")]
SEED_LOG_DEFAULT = "UserRegistered"


def seed_tables(spark: SparkSession, as_of: str) -> dict[str, DataFrame]:
    now = ts_ntz(as_of)
    plans = spark.createDataFrame(
        [(i + 1, n, None, p, c, d, None) for i, (n, p, d, c) in enumerate(SEED_PLANS)],
        "plan_id bigint, name string, description string, price string, billing_cycle string, duration_days int, features string",
    ).select("plan_id", "name", "description", F.col("price").cast(S.MONEY).alias("price"), "billing_cycle",
             "duration_days", "features", now.alias("created_at"), F.lit(None).cast(S.TS).alias("updated_at"))
    n = F.col("id")
    users = spark.range(1, 21).select(
        n.cast("bigint").alias("user_id"), F.concat(F.lit("First"), n.cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), n.cast("string")).alias("last_name"),
        F.concat(F.lit("user"), n.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555000"), F.lpad(n.cast("string"), 4, "0")).alias("phone"), F.lit(None).cast("string").alias("address"),
        now.alias("registration_date"), F.when(n == 1, "Admin").otherwise("Subscriber").alias("role"))
    base = spark.range(1, 31).select(
        n.cast("bigint").alias("subscription_id"), (F.floor((n - 1) / 10) + 1).cast("bigint").alias("user_id"),
        ((n - 1) % 10 + 1).cast("bigint").alias("plan_id"),
        add_days(now, -((n * 3) % 90).cast("int")).alias("start_date"))
    days = plans.select("plan_id", "duration_days", "price")
    subs = base.join(days, "plan_id").select(
        "subscription_id", "user_id", "plan_id", "start_date",
        add_days(F.col("start_date"), F.col("duration_days")).alias("end_date"), F.lit(None).cast(S.TS).alias("renewal_date"),
        F.when(F.col("subscription_id") % 10 == 0, "Cancelled").when(F.col("subscription_id") % 7 == 0, "Expired")
         .otherwise("Active").alias("status"), (F.col("subscription_id") % 2 == 0).alias("auto_renew"))
    sid = F.col("subscription_id")
    pays = subs.where(sid <= 25).join(days, "plan_id").select(
        sid.alias("payment_id"), sid.alias("subscription_id"), F.col("price").alias("amount"),
        add_days(F.col("start_date"), (sid % 15 - 7).cast("int")).alias("payment_date"),
        F.when(sid % 3 == 0, "PayPal").otherwise("Credit Card").alias("payment_method"),
        F.concat(F.lit("TXN-"), sid.cast("string")).alias("transaction_id"),
        F.when(sid % 13 == 0, "Refunded").otherwise("Completed").alias("status"))
    action = F.lit(SEED_LOG_DEFAULT)
    for m, a in reversed(SEED_LOG_ACTIONS):
        action = F.when(n % m == 0, a).otherwise(action)
    logs = spark.range(1, 51).select(
        n.cast("bigint").alias("log_id"), F.when(n % 5 == 0, F.lit(None).cast("bigint")).otherwise((n % 20 + 1).cast("bigint")).alias("user_id"),
        action.alias("action"), F.concat(F.lit("Seed log entry #"), n.cast("string")).alias("message"),
        add_days(now, -(n % 30).cast("int")).alias("log_date"))
    return {"plans": plans, "users": users, "subscriptions": subs, "payments": pays, "logs": logs}
