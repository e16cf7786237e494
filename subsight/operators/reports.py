"""Reports: revenue, payment totals, plan metrics, churn, mean duration,
expired-per-plan, reference counts and the admin KPI row.

Every report aggregates before it joins: the per-plan partial aggregate is
at most one row per plan, so the join with plan names never sees the
subscription rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import add_days, day_diff, in_range, lit_ts
from ..functions.predicates import equals_opt, expired_like, strictly_active
from ..sources import schemas as S


def _money_sum(c) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(S.TOTAL)


def revenue(payments: DataFrame, date_from, date_to) -> DataFrame:
    """Sum of Completed amounts with from <= date < to + 1 day; 0 when none."""
    p = payments.where((F.col("status") == "Completed") & in_range(F.col("payment_date"), date_from, date_to))
    return p.agg(_money_sum("amount").alias("revenue"))


def payments_total(payments: DataFrame, date_from=None, date_to=None, status=None) -> DataFrame:
    p = payments.where(in_range(F.col("payment_date"), date_from, date_to) & equals_opt(F.col("status"), status))
    return p.agg(_money_sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("payment_count"))


def plan_metrics(subscriptions: DataFrame, plans: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Per plan: subscriptions started in range, how many are Cancelled, churn.

    Plans without subscriptions in range do not appear; ordered by name."""
    s = subscriptions.where(in_range(F.col("start_date"), date_from, date_to))
    per_plan = s.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("total_subscriptions"),
        F.sum(F.when(F.col("status") == "Cancelled", 1).otherwise(0)).cast("bigint").alias("cancelled_subscriptions"))
    names = plans.select("plan_id", F.col("name").alias("plan_name"))
    return (per_plan.join(names, "plan_id")
            .select("plan_id", "plan_name", "total_subscriptions", "cancelled_subscriptions",
                    (F.col("cancelled_subscriptions") / F.col("total_subscriptions")).alias("churn_rate"))
            .orderBy("plan_name", "plan_id"))


def _churn_cols():
    cancelled = F.sum(F.when(F.col("status") == "Cancelled", 1).otherwise(0))
    return F.coalesce(cancelled / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))


def churn_rate(subscriptions: DataFrame) -> DataFrame:
    """Cancelled / all subscriptions; 0 for an empty table."""
    return subscriptions.agg(_churn_cols().cast("double").alias("churn_rate"))


def _avg_duration():
    return F.coalesce(F.avg(day_diff(F.col("end_date"), F.col("start_date")).cast("double")), F.lit(0.0))


def avg_duration_days(subscriptions: DataFrame) -> DataFrame:
    """Mean of DATEDIFF(DAY, start, end); 0 for an empty table."""
    return subscriptions.agg(_avg_duration().alias("avg_duration_days"))


def expired_by_plan(subscriptions: DataFrame, plans: DataFrame, as_of) -> DataFrame:
    s = subscriptions.where(expired_like(F.col("status"), F.col("end_date"), as_of))
    per_plan = s.groupBy("plan_id").agg(F.count(F.lit(1)).alias("expired_count"))
    names = plans.select("plan_id", F.col("name").alias("plan_name"))
    return (per_plan.join(names, "plan_id").select("plan_id", "plan_name", "expired_count")
            .orderBy(F.desc("expired_count"), "plan_name", "plan_id"))


def subscriptions_per(parent: DataFrame, key: str, subscriptions: DataFrame) -> DataFrame:
    """Reference count of each parent row (0 when unreferenced)."""
    counts = subscriptions.groupBy(key).agg(F.count(F.lit(1)).alias("subscription_count"))
    return (parent.select(key).join(counts, key, "left")
            .select(key, F.coalesce("subscription_count", F.lit(0)).cast("bigint").alias("subscription_count")))


def admin_kpis(payments: DataFrame, subscriptions: DataFrame, as_of) -> DataFrame:
    """Dashboard row: revenue of the 30 days up to as_of, churn, mean duration.

    The payment total is a scalar subquery, so the two one-row aggregates are
    combined without a join."""
    start = add_days(lit_ts(as_of), -30)
    rev = revenue(payments, start, lit_ts(as_of)).scalar()
    return subscriptions.agg(
        _churn_cols().cast("double").alias("churn_rate"),
        _avg_duration().alias("avg_duration_days"),
    ).select(rev.alias("revenue_30d"), "churn_rate", "avg_duration_days")


def is_subscription_active(subscriptions: DataFrame, keys: DataFrame, as_of) -> DataFrame:
    """Bulk form of the scalar function: one row per key, false for unknown ids."""
    active = (subscriptions.where(strictly_active(F.col("status"), F.col("end_date"), as_of))
              .select("subscription_id", F.lit(True).alias("hit")))
    return (keys.select("subscription_id").join(active, "subscription_id", "left")
            .select("subscription_id", F.coalesce("hit", F.lit(False)).alias("is_active")))


