"""Registered listings, views, lookups and read models."""

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions.predicates import due_for_expiry
from ..operators import listing as L
from ..operators import lookups as K
from ..operators import views as V
from ..sources import commands as C
from .registry import AS_OF, REPORT_FROM, REPORT_TO, query
from .reports import LOOKUP_SUBSCRIPTION_KEYS_SQL, lookup_subscription_keys

_START_RANGE = (f"s.start_date >= TIMESTAMP '{REPORT_FROM} 00:00:00' "
                f"AND s.start_date < TIMESTAMP '{REPORT_TO} 00:00:00' + INTERVAL 1 DAY")

PLANS_REQ = L.PageRequest(page=3, page_size=20, sort_by="Price", sort_dir="asc")
USERS_REQ = L.PageRequest(page=2, page_size=25, sort_by="email", sort_dir="ASC")
SUBS_REQ = L.PageRequest(page=2, page_size=50, sort_by="EndDate", sort_dir="desc")
PAYS_REQ = L.PageRequest(page=5, page_size=200, sort_by="amount", sort_dir="desc")
SUBS_FILTER = dict(user_email="customer.0000001", status="active", date_from=REPORT_FROM, date_to=REPORT_TO)


@query("filter_payments_range", f"""
SELECT payment_id, subscription_id, amount, payment_date, payment_method, transaction_id, status FROM payments
WHERE payment_date >= TIMESTAMP '{REPORT_FROM} 00:00:00' AND payment_date < TIMESTAMP '{REPORT_TO} 00:00:00' + INTERVAL 1 DAY""")
def filter_payments_range(t):
    """payments dated within 2000 (upper bound exclusive of to + 1 day)."""
    return L.payments_filtered(t.payments, REPORT_FROM, REPORT_TO)


@query("filter_subscriptions_status", """
SELECT subscription_id, user_id, plan_id, start_date, end_date, renewal_date, status, auto_renew
FROM subscriptions WHERE status = 'Cancelled'""")
def filter_subscriptions_status(t):
    """optional status equality, parameter given in another case."""
    from ..functions.predicates import equals_opt
    return t.subscriptions.where(equals_opt(F.col("status"), "CANCELLED")).select(*L.SUBSCRIPTION_COLS)


@query("search_plans", """
SELECT plan_id, name, description, price, billing_cycle, duration_days, features, created_at, updated_at
FROM plans WHERE name ILIKE '%red%' OR billing_cycle ILIKE '%red%'""")
def search_plans(t):
    """contains-search over plan name and billing cycle."""
    return L.plans_filtered(t.plans, search="Red")


@query("search_users", """
SELECT user_id, first_name, last_name, email, phone, address, registration_date, role
FROM users WHERE email ILIKE '%0000012%' OR first_name ILIKE '%0000012%' OR last_name ILIKE '%0000012%'""")
def search_users(t):
    """contains-search over e-mail, first and last name."""
    return L.users_filtered(t.users, search="0000012")


@query("search_subscriptions_email", """
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, s.end_date, s.renewal_date, s.status, s.auto_renew,
       u.email AS user_email, p.name AS plan_name
FROM subscriptions s JOIN users u ON s.user_id = u.user_id JOIN plans p ON s.plan_id = p.plan_id
WHERE u.email ILIKE '%customer.00000011%'""")
def search_subscriptions_email(t):
    """subscriptions whose user's e-mail contains the text."""
    return L.subscriptions_filtered(t.subscriptions, t.users, t.plans, user_email="CUSTOMER.00000011")


@query("due_subscriptions", f"""
SELECT subscription_id, user_id, plan_id, end_date FROM subscriptions
WHERE status = 'Active' AND end_date <= TIMESTAMP '{AS_OF}'""")
def due_subscriptions(t):
    """Active with end date at or before as_of."""
    return (t.subscriptions.where(due_for_expiry(F.col("status"), F.col("end_date"), AS_OF))
            .select("subscription_id", "user_id", "plan_id", "end_date"))


@query("lookup_plans", """
SELECT k.plan_id, p.plan_id IS NOT NULL AS found, p.name, p.price, p.duration_days
FROM (SELECT CASE WHEN plan_id % 97 = 5 THEN -plan_id - 1 ELSE plan_id END AS plan_id FROM plans) k
LEFT JOIN plans p ON p.plan_id = k.plan_id""")
def lookup_plans(t):
    """bulk lookup of plans by id (unknown ids give found = false)."""
    return K.lookup(t.plans, C.plan_deletes(t), "plan_id", ["name", "price", "duration_days"])


@query("lookup_users", """
SELECT k.user_id, u.user_id IS NOT NULL AS found, u.email, u.role
FROM (SELECT CASE WHEN user_id % 97 = 5 THEN -user_id - 1 ELSE user_id END AS user_id FROM users) k
LEFT JOIN users u ON u.user_id = k.user_id""")
def lookup_users(t):
    """bulk lookup of users by id."""
    return K.lookup(t.users, C.user_deletes(t), "user_id", ["email", "role"])


@query("lookup_subscriptions", """
SELECT k.subscription_id, s.subscription_id IS NOT NULL AS found, s.user_id, s.status, u.email AS user_email, p.name AS plan_name
FROM lookup_keys k
LEFT JOIN (subscriptions s JOIN users u ON s.user_id = u.user_id JOIN plans p ON s.plan_id = p.plan_id)
  ON s.subscription_id = k.subscription_id""", ctes={"lookup_keys": LOOKUP_SUBSCRIPTION_KEYS_SQL})
def lookup_subscriptions(t):
    """bulk lookup of subscriptions with user e-mail and plan name."""
    full = L.subscriptions_filtered(t.subscriptions, t.users, t.plans)
    return K.lookup(full, lookup_subscription_keys(t), "subscription_id", ["user_id", "status", "user_email", "plan_name"])


@query("subscription_actions", """
SELECT subscription_id, status,
       CASE status WHEN 'Active' THEN 'Renew,Cancel' WHEN 'Expired' THEN 'Renew' ELSE '' END AS actions
FROM subscriptions""")
def subscription_actions(t):
    """allowed actions per subscription."""
    return V.subscription_actions(t.subscriptions)


@query("payments_refundable", """
SELECT payment_id, status, status = 'Completed' AS refundable FROM payments""")
def payments_refundable(t):
    """refundable flag."""
    return V.payments_refundable(t.payments)


@query("user_subscriptions", """
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, s.end_date, s.renewal_date, s.status, s.auto_renew,
       p.name AS plan_name
FROM subscriptions s JOIN plans p ON s.plan_id = p.plan_id""")
def user_subscriptions(t):
    """Every user's subscriptions with plan names."""
    return V.user_subscriptions(t.subscriptions, t.plans)


@query("user_payments", """
SELECT s.user_id, pm.payment_id, pm.subscription_id, pm.amount, pm.payment_date, pm.payment_method,
       pm.transaction_id, pm.status
FROM payments pm JOIN subscriptions s ON pm.subscription_id = s.subscription_id""")
def user_payments(t):
    """Every user's payments through their subscriptions."""
    return V.user_payments(t.payments, t.subscriptions)


@query("email_exists", """
SELECT b.seq, b.email, EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(b.email)) AS email_exists
FROM bulk_users b""", ctes={"bulk_users": C.SQL["bulk_users"]})
def email_exists(t):
    """E-mail already registered, per incoming user row."""
    keys = C.bulk_users(t).select("seq", "email")
    return K.exists_flag(keys, t.users, "email", name="email_exists")


@query("deletable_plans", """
SELECT p.plan_id, p.name FROM plans p
WHERE NOT EXISTS (SELECT 1 FROM subscriptions s WHERE s.plan_id = p.plan_id)""")
def deletable_plans(t):
    """Plans no subscription refers to."""
    return K.unreferenced(t.plans.select("plan_id", "name"), t.subscriptions, "plan_id")


@query("deletable_users", """
SELECT u.user_id, u.email FROM users u
WHERE NOT EXISTS (SELECT 1 FROM subscriptions s WHERE s.user_id = u.user_id)""")
def deletable_users(t):
    """Users without subscriptions."""
    return K.unreferenced(t.users.select("user_id", "email"), t.subscriptions, "user_id")


@query("duplicate_plan_names", """
SELECT lower(name) AS key, COUNT(*) AS row_count, MIN(plan_id) AS min_id, MAX(plan_id) AS max_id
FROM plans GROUP BY lower(name) HAVING COUNT(*) > 1""")
def duplicate_plan_names(t):
    """Plan names used by more than one plan (case-insensitive)."""
    return K.duplicate_groups(t.plans, "name", "plan_id")


@query("duplicate_emails", """
SELECT lower(email) AS key, COUNT(*) AS row_count, MIN(user_id) AS min_id, MAX(user_id) AS max_id
FROM users GROUP BY lower(email) HAVING COUNT(*) > 1""")
def duplicate_emails(t):
    """E-mails used by more than one user."""
    return K.duplicate_groups(t.users, "email", "user_id")


@query("active_subscriptions", """
SELECT s.subscription_id, s.user_id, u.first_name, u.last_name, u.email, s.plan_id, p.name AS plan_name,
       p.billing_cycle, s.start_date, s.end_date, s.auto_renew
FROM subscriptions s JOIN users u ON s.user_id = u.user_id JOIN plans p ON s.plan_id = p.plan_id
WHERE s.status = 'Active'""")
def active_subscriptions(t):
    """V1: vw_ActiveSubscriptions."""
    return V.active_subscriptions(t.subscriptions, t.users, t.plans)


@query("user_payment_history", """
SELECT u.user_id, u.first_name, u.last_name, u.email, s.subscription_id, pm.payment_id, pm.amount, pm.payment_date,
       pm.payment_method, pm.transaction_id, pm.status AS payment_status, s.plan_id, pl.name AS plan_name
FROM users u JOIN subscriptions s ON u.user_id = s.user_id JOIN payments pm ON s.subscription_id = pm.subscription_id
JOIN plans pl ON s.plan_id = pl.plan_id""")
def user_payment_history(t):
    """V2: vw_UserPaymentHistory."""
    return V.user_payment_history(t.users, t.subscriptions, t.payments, t.plans)


@query("user_360", f"""
WITH pay AS (
  SELECT subscription_id, COUNT(*) AS n_pay,
         SUM(CASE WHEN status = 'Completed' THEN amount ELSE 0 END) AS paid,
         SUM(CASE WHEN status = 'Refunded' THEN amount ELSE 0 END) AS refunded,
         MAX(payment_date) AS last_pay
  FROM payments GROUP BY subscription_id),
per_user AS (
  SELECT s.user_id, COUNT(*) AS subscription_count,
         SUM(CASE WHEN s.status = 'Active' THEN 1 ELSE 0 END) AS active_status_count,
         SUM(CASE WHEN s.status = 'Active' AND s.end_date > TIMESTAMP '{AS_OF}' THEN 1 ELSE 0 END) AS active_now_count,
         SUM(CASE WHEN s.status = 'Cancelled' THEN 1 ELSE 0 END) AS cancelled_count,
         COALESCE(SUM(n_pay), 0) AS payment_count, SUM(paid) AS paid, SUM(refunded) AS refunded,
         MAX(s.start_date) AS last_start_date, MAX(last_pay) AS last_payment_date
  FROM subscriptions s LEFT JOIN pay ON pay.subscription_id = s.subscription_id GROUP BY s.user_id)
SELECT u.user_id, u.first_name, u.last_name, u.email, u.role, u.registration_date,
       CAST(COALESCE(subscription_count, 0) AS BIGINT) AS subscription_count,
       CAST(COALESCE(active_status_count, 0) AS BIGINT) AS active_status_count,
       CAST(COALESCE(active_now_count, 0) AS BIGINT) AS active_now_count,
       CAST(COALESCE(cancelled_count, 0) AS BIGINT) AS cancelled_count,
       CAST(COALESCE(payment_count, 0) AS BIGINT) AS payment_count,
       CAST(COALESCE(paid, 0) AS DECIMAL(18,2)) AS completed_total,
       CAST(COALESCE(refunded, 0) AS DECIMAL(18,2)) AS refunded_total,
       last_start_date, last_payment_date
FROM users u LEFT JOIN per_user pu ON pu.user_id = u.user_id""")
def user_360(t):
    """V3: one summary row per user (counts, sums, latest dates)."""
    return V.user_360(t.users, t.subscriptions, t.payments, AS_OF)


@query("latest_completed_payment", """
SELECT subscription_id, payment_id, amount, payment_date FROM (
  SELECT subscription_id, payment_id, amount, payment_date,
         row_number() OVER (PARTITION BY subscription_id ORDER BY payment_date DESC, payment_id DESC) AS rn
  FROM payments WHERE status = 'Completed') WHERE rn = 1""")
def latest_completed_payment(t):
    """Latest Completed payment per subscription."""
    return V.latest_completed_payment(t.payments)


@query("plans_page", """
SELECT plan_id, name, description, price, billing_cycle, duration_days, features, created_at, updated_at
FROM plans WHERE billing_cycle = 'Yearly'
ORDER BY price ASC NULLS FIRST, plan_id ASC LIMIT 20 OFFSET 40""")
def plans_page(t):
    """Plans page 3 of 20, yearly plans, by price ascending."""
    return L.plans_page(t.plans, PLANS_REQ, billing_cycle="yearly")


@query("users_page", """
SELECT user_id, first_name, last_name, email, phone, address, registration_date, role FROM users
WHERE email ILIKE '%customer%' OR first_name ILIKE '%customer%' OR last_name ILIKE '%customer%'
ORDER BY email ASC NULLS FIRST, user_id ASC LIMIT 25 OFFSET 25""")
def users_page(t):
    """Users page 2 of 25 by e-mail."""
    return L.users_page(t.users, USERS_REQ, search="Customer")


_SUBS_WHERE = f"u.email ILIKE '%customer.0000001%' AND s.status = 'Active' AND {_START_RANGE}"


@query("subscriptions_page", f"""
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, s.end_date, s.renewal_date, s.status, s.auto_renew,
       u.email AS user_email, p.name AS plan_name
FROM subscriptions s JOIN users u ON s.user_id = u.user_id JOIN plans p ON s.plan_id = p.plan_id
WHERE {_SUBS_WHERE}
ORDER BY s.end_date DESC NULLS LAST, s.subscription_id DESC LIMIT 50 OFFSET 50""")
def subscriptions_page(t):
    """Subscriptions page with e-mail search, status and start range, by end date desc."""
    return L.subscriptions_page(t.subscriptions, t.users, t.plans, SUBS_REQ, **SUBS_FILTER)


@query("payments_page", """
SELECT payment_id, subscription_id, amount, payment_date, payment_method, transaction_id, status FROM payments
WHERE status = 'Completed' ORDER BY amount DESC NULLS LAST, payment_id DESC LIMIT 200 OFFSET 800""")
def payments_page(t):
    """Payments page 5 of 200, Completed, by amount desc."""
    return L.payments_page(t.payments, PAYS_REQ, status="completed")


@query("payments_page_after", """
SELECT payment_id, subscription_id, amount, payment_date, payment_method, transaction_id, status FROM payments
WHERE status = 'Completed' AND (amount < 20000.00 OR (amount = 20000.00 AND payment_id < 1000)) ORDER BY amount DESC, payment_id DESC LIMIT 200""")
def payments_page_after(t):
    """P4 by keyset: the page after amount 20000.00, payment 1000."""
    return L.payments_page_after(t.payments, PAYS_REQ, Decimal("20000.00"), 1000, status="completed")


@query("page_totals", f"""
SELECT (SELECT COUNT(*) FROM plans WHERE billing_cycle = 'Yearly') AS plans_total,
       (SELECT COUNT(*) FROM users WHERE email ILIKE '%customer%' OR first_name ILIKE '%customer%'
                                      OR last_name ILIKE '%customer%') AS users_total,
       (SELECT COUNT(*) FROM subscriptions s JOIN users u ON s.user_id = u.user_id JOIN plans p ON s.plan_id = p.plan_id
         WHERE {_SUBS_WHERE}) AS subscriptions_total,
       (SELECT COUNT(*) FROM payments WHERE status = 'Completed') AS payments_total""")
def page_totals(t):
    """Row counts under the same filters as the four pages."""
    plans_n = L.total(L.plans_filtered(t.plans, billing_cycle="yearly"))
    users_n = L.total(L.users_filtered(t.users, search="Customer")).scalar()
    subs_n = L.total(L.subscriptions_filtered(t.subscriptions, t.users, t.plans, **SUBS_FILTER)).scalar()
    pays_n = L.total(L.payments_filtered(t.payments, status="completed")).scalar()
    return plans_n.select(F.col("total").alias("plans_total"), users_n.alias("users_total"),
                          subs_n.alias("subscriptions_total"), pays_n.alias("payments_total"))


@query("page_info", f"""
SELECT total, 2 AS page, 50 AS page_size, CAST(ceil(total / 50.0) AS BIGINT) AS total_pages,
       true AS has_previous, 2 < CAST(ceil(total / 50.0) AS BIGINT) AS has_next
FROM (SELECT COUNT(*) AS total FROM subscriptions s JOIN users u ON s.user_id = u.user_id
      JOIN plans p ON s.plan_id = p.plan_id WHERE {_SUBS_WHERE})""")
def page_info(t):
    """Page maths for the subscriptions page."""
    return L.page_info(L.total(L.subscriptions_filtered(t.subscriptions, t.users, t.plans, **SUBS_FILTER)), SUBS_REQ)


@query("plans_all", """
SELECT plan_id, name, description, price, billing_cycle, duration_days, features, created_at, updated_at FROM plans""")
def plans_all(t):
    """Every plan, newest first."""
    return L.plans_all(t.plans)


@query("payments_by_subscription", """
SELECT payment_id, subscription_id, amount, payment_date, payment_method, transaction_id, status FROM payments
WHERE subscription_id IN (SELECT subscription_id FROM lookup_keys)""", ctes={"lookup_keys": LOOKUP_SUBSCRIPTION_KEYS_SQL})
def payments_by_subscription(t):
    """Payments of a key set of subscriptions, newest first."""
    return L.payments_by_subscription(t.payments, lookup_subscription_keys(t))

