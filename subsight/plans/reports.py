"""Registered reports."""

from pyspark.sql import functions as F

from ..operators import reports as R
from .registry import AS_OF, REPORT_FROM, REPORT_TO, query

_RANGE = f"payment_date >= TIMESTAMP '{REPORT_FROM} 00:00:00' AND payment_date < TIMESTAMP '{REPORT_TO} 00:00:00' + INTERVAL 1 DAY"


@query("revenue", f"""
SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(18,2)) AS revenue
FROM payments WHERE status = 'Completed' AND {_RANGE}""")
def revenue(t):
    """Completed revenue of 2000 (inclusive end date)."""
    return R.revenue(t.payments, REPORT_FROM, REPORT_TO)


@query("payments_total", f"""
SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(18,2)) AS total_amount, COUNT(*) AS payment_count
FROM payments WHERE {_RANGE} AND status = 'Refunded'""")
def payments_total(t):
    """A2: total of payments in range with a status filter (given in lower case)."""
    return R.payments_total(t.payments, REPORT_FROM, REPORT_TO, "refunded")


@query("plan_metrics", f"""
SELECT p.plan_id, p.name AS plan_name, COUNT(*) AS total_subscriptions,
       CAST(SUM(CASE WHEN s.status = 'Cancelled' THEN 1 ELSE 0 END) AS BIGINT) AS cancelled_subscriptions,
       CAST(SUM(CASE WHEN s.status = 'Cancelled' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS churn_rate
FROM subscriptions s JOIN plans p ON s.plan_id = p.plan_id
WHERE s.start_date >= TIMESTAMP '{REPORT_FROM} 00:00:00' AND s.start_date < TIMESTAMP '{REPORT_TO} 00:00:00' + INTERVAL 1 DAY
GROUP BY p.plan_id, p.name ORDER BY plan_name, p.plan_id""")
def plan_metrics(t):
    """A3: per plan totals, cancellations and churn for subscriptions started in 2000."""
    return R.plan_metrics(t.subscriptions, t.plans, REPORT_FROM, REPORT_TO)


@query("churn_rate", """
SELECT COALESCE(CAST(SUM(CASE WHEN status = 'Cancelled' THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(COUNT(*), 0), 0.0) AS churn_rate
FROM subscriptions""")
def churn_rate(t):
    """A4: overall churn."""
    return R.churn_rate(t.subscriptions)


@query("avg_duration_days", """
SELECT COALESCE(AVG(CAST(date_diff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) AS DOUBLE)), 0.0) AS avg_duration_days
FROM subscriptions""")
def avg_duration_days(t):
    """A5: mean duration in days (midnights crossed)."""
    return R.avg_duration_days(t.subscriptions)


@query("expired_by_plan", f"""
SELECT s.plan_id, p.name AS plan_name, COUNT(*) AS expired_count
FROM subscriptions s JOIN plans p ON s.plan_id = p.plan_id
WHERE s.status = 'Expired' OR s.end_date <= TIMESTAMP '{AS_OF}'
GROUP BY s.plan_id, p.name ORDER BY expired_count DESC, plan_name, s.plan_id""")
def expired_by_plan(t):
    """Expired or ended by as_of, per plan."""
    return R.expired_by_plan(t.subscriptions, t.plans, AS_OF)


@query("subscriptions_per_plan", """
SELECT p.plan_id, CAST(COUNT(s.subscription_id) AS BIGINT) AS subscription_count
FROM plans p LEFT JOIN subscriptions s ON s.plan_id = p.plan_id GROUP BY p.plan_id""")
def subscriptions_per_plan(t):
    """Subscriptions referencing each plan."""
    return R.subscriptions_per(t.plans, "plan_id", t.subscriptions)


@query("subscriptions_per_user", """
SELECT u.user_id, CAST(COUNT(s.subscription_id) AS BIGINT) AS subscription_count
FROM users u LEFT JOIN subscriptions s ON s.user_id = u.user_id GROUP BY u.user_id""")
def subscriptions_per_user(t):
    """Subscriptions referencing each user."""
    return R.subscriptions_per(t.users, "user_id", t.subscriptions)


@query("admin_kpis", f"""
SELECT (SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(18,2)) FROM payments
        WHERE status = 'Completed' AND payment_date >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
          AND payment_date < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY) AS revenue_30d,
       COALESCE(CAST(SUM(CASE WHEN status = 'Cancelled' THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(COUNT(*), 0), 0.0) AS churn_rate,
       COALESCE(AVG(CAST(date_diff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) AS DOUBLE)), 0.0) AS avg_duration_days
FROM subscriptions""")
def admin_kpis(t):
    """A10: one-row admin dashboard."""
    return R.admin_kpis(t.payments, t.subscriptions, AS_OF)


LOOKUP_SUBSCRIPTION_KEYS_SQL = """
SELECT CASE WHEN subscription_id % 9 = 0 THEN -subscription_id - 1 ELSE subscription_id END AS subscription_id FROM subscriptions"""


def lookup_subscription_keys(t):
    """Every subscription id, every 9th shifted out of range (unknown)."""
    s = F.col("subscription_id")
    return t.subscriptions.select(F.when(s % 9 == 0, -s - 1).otherwise(s).alias("subscription_id"))


@query("is_subscription_active", f"""
SELECT k.subscription_id,
       EXISTS (SELECT 1 FROM subscriptions s WHERE s.subscription_id = k.subscription_id
               AND s.status = 'Active' AND s.end_date > TIMESTAMP '{AS_OF}') AS is_active
FROM lookup_keys k""", ctes={"lookup_keys": LOOKUP_SUBSCRIPTION_KEYS_SQL})
def is_subscription_active(t):
    """Active flag for a key set (unknown ids give false)."""
    return R.is_subscription_active(t.subscriptions, lookup_subscription_keys(t), AS_OF)
