"""Registered queries over the named views and SQL functions, and deep pages by position."""

from ..operators import listing as L
from ..operators import named as N
from ..session import scratch_path
from .registry import AS_OF, REPORT_FROM, REPORT_TO, query

A = f"TIMESTAMP '{AS_OF}'"


def _sql(t, text, **args):
    N.register(t.spark, t)
    return t.spark.sql(text, args)


@query("sql_active_subscriptions", """
SELECT s.subscription_id, s.user_id, u.first_name, u.last_name, u.email, s.plan_id, p.name AS plan_name, p.billing_cycle,
       s.start_date, s.end_date, s.auto_renew
FROM subscriptions s JOIN users u ON s.user_id = u.user_id JOIN plans p ON s.plan_id = p.plan_id WHERE s.status = 'Active'""")
def sql_active_subscriptions(t):
    """V1 by name: SELECT from vw_active_subscriptions."""
    return _sql(t, "SELECT * FROM vw_active_subscriptions")


@query("sql_payment_history_by_plan", """
SELECT p.name AS plan_name, pm.status AS payment_status, COUNT(*) AS payments, CAST(SUM(pm.amount) AS DECIMAL(38,2)) AS amount,
       COUNT(DISTINCT s.user_id) AS users
FROM payments pm JOIN subscriptions s ON pm.subscription_id = s.subscription_id JOIN users u ON s.user_id = u.user_id
JOIN plans p ON s.plan_id = p.plan_id GROUP BY p.name, pm.status""")
def sql_payment_history_by_plan(t):
    """V2 by name: payments per plan and status from vw_user_payment_history."""
    return _sql(t, """SELECT plan_name, payment_status, count(*) AS payments, CAST(sum(amount) AS DECIMAL(38,2)) AS amount,
                             count(DISTINCT user_id) AS users
                      FROM vw_user_payment_history GROUP BY plan_name, payment_status""")


@query("sql_revenue", f"""
SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(18,2)) AS revenue FROM payments
WHERE status = 'Completed' AND payment_date >= TIMESTAMP '{REPORT_FROM}' AND payment_date < TIMESTAMP '{REPORT_TO}' + INTERVAL 1 DAY""")
def sql_revenue(t):
    """U2 as a SQL statement with parameters."""
    return _sql(t, N.REVENUE, date_from=REPORT_FROM, date_to=REPORT_TO)


@query("sql_is_subscription_active", f"""
SELECT subscription_id, status = 'Active' AND end_date > {A} AS is_active FROM subscriptions
UNION ALL SELECT -subscription_id - 1, false FROM subscriptions""")
def sql_is_subscription_active(t):
    """U1 as a SQL function of a column: every subscription, and as many unknown ids."""
    return _sql(t, f"""SELECT subscription_id, is_subscription_active(subscription_id, TIMESTAMP_NTZ '{AS_OF}') AS is_active
                       FROM (SELECT subscription_id FROM subscriptions UNION ALL SELECT -subscription_id - 1 FROM subscriptions)""")


def _deep(t, listing, sort_col, key, req):
    index = L.position_index(listing, sort_col, key, req, scratch_path(t.spark, "page-index"))
    return L.page_at(index, req).drop("position")


@query("plans_page_deep", """
SELECT plan_id, name, description, price, billing_cycle, duration_days, features, created_at, updated_at FROM plans
ORDER BY price ASC NULLS FIRST, plan_id ASC LIMIT 20 OFFSET 1180""")
def plans_page_deep(t):
    """P1 by position: plans page 60 of 20, by price."""
    return _deep(t, L.plans_filtered(t.plans), "price", "plan_id", L.PageRequest(60, 20, "price", "asc"))


@query("users_page_deep", """
SELECT user_id, first_name, last_name, email, phone, address, registration_date, role FROM users
ORDER BY email DESC NULLS LAST, user_id DESC LIMIT 25 OFFSET 1225""")
def users_page_deep(t):
    """P2 by position: users page 50 of 25, by e-mail descending."""
    return _deep(t, L.users_filtered(t.users), "email", "user_id", L.PageRequest(50, 25, "email", "desc"))


@query("subscriptions_page_deep", """
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, s.end_date, s.renewal_date, s.status, s.auto_renew,
       u.email AS user_email, p.name AS plan_name
FROM subscriptions s JOIN users u ON s.user_id = u.user_id JOIN plans p ON s.plan_id = p.plan_id
ORDER BY s.end_date DESC NULLS LAST, s.subscription_id DESC LIMIT 50 OFFSET 9950""")
def subscriptions_page_deep(t):
    """P3 by position: subscriptions page 200 of 50, by end date descending."""
    return _deep(t, L.subscriptions_filtered(t.subscriptions, t.users, t.plans), "end_date", "subscription_id",
                 L.PageRequest(200, 50, "end_date", "desc"))
