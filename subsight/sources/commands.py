"""Command inputs for the change jobs, derived from whole tables.

Every command set covers every row of its source table (no sampling);
a rule on the key makes a share of them invalid on purpose, so rejection
paths run at every scale. ``SQL`` holds the same derivations for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schemas as S
from .tables import Tables, padded

# an unknown id is negative, so it names no row at any table size


def _shift_unknown(c: Column, rule: Column) -> Column:
    return F.when(rule, -c - 1).otherwise(c)


def plan_upserts(t: Tables) -> DataFrame:
    """One command per plan; even ids reuse the plan's name (update), odd ids a new name (insert)."""
    p = t.plans
    pid = F.col("plan_id")
    return p.select(
        pid.cast("bigint").alias("seq"),
        F.when(pid % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("New plan #"), pid.cast("string"))).alias("name"),
        "description", (F.col("price") + 1).cast(S.MONEY).alias("price"),
        F.lit("Yearly").alias("billing_cycle"), F.lit(365).alias("duration_days"), "features")


def plan_updates(t: Tables) -> DataFrame:
    """One per plan; every 50th takes the next plan's name (clash), every 97th an unknown id."""
    p = t.plans.alias("p")
    nxt = t.plans.select((F.col("plan_id") - 1).alias("plan_id"), F.col("name").alias("next_name"))
    pid = F.col("plan_id")
    j = p.join(nxt, "plan_id", "left")
    return j.select(
        pid.cast("bigint").alias("seq"),
        _shift_unknown(pid, pid % 97 == 5).alias("plan_id"),
        F.when((pid % 50 == 7) & F.col("next_name").isNotNull(), F.col("next_name")).otherwise(F.col("name")).alias("name"),
        F.concat(F.coalesce("description", F.lit("")), F.lit(" (v2)")).alias("description"),
        (F.col("price") + F.lit(2)).cast(S.MONEY).alias("price"), "billing_cycle", "duration_days", "features")


def _handed_on(table: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Commands that hand unique values on: every row gives its value up for a
    fresh one (command 2 x id), then the next row takes it (2 x id + 3). Every
    tenth row asks for its follower's value instead, which is not free yet, and
    for nothing else; so it keeps its own, and its follower cannot take it."""
    i = F.col(id_col).cast("bigint")
    near = lambda d: table.select((F.col(id_col) - d).alias(id_col), F.col(value_col).alias("_near"))
    away = table.join(near(1), id_col, "left").withColumn("seq", 2 * i).withColumn(
        value_col, F.when((i % 10 == 3) & F.col("_near").isNotNull(), F.col("_near")).otherwise(F.concat(F.lit("freed."), F.col(value_col))))
    take = table.join(near(-1), id_col).where(i % 10 != 3).withColumn("seq", 2 * i + 1).withColumn(value_col, F.col("_near"))
    return away.unionByName(take).drop("_near")


def plan_renames(t: Tables) -> DataFrame:
    """Names handed on from plan to plan, two commands per plan."""
    return _handed_on(t.plans, "plan_id", "name").select(
        "seq", "plan_id", "name", "description", "price", "billing_cycle", "duration_days", "features")


def user_moves(t: Tables) -> DataFrame:
    """E-mails handed on from user to user, two commands per user."""
    return _handed_on(t.users, "user_id", "email").select(
        "seq", "user_id", "first_name", "last_name", "email", "phone", "address", "role")


def plan_deletes(t: Tables) -> DataFrame:
    pid = F.col("plan_id")
    return t.plans.select(pid.cast("bigint").alias("seq"), _shift_unknown(pid, pid % 97 == 5).alias("plan_id"))


def bulk_users(t: Tables) -> DataFrame:
    """One user per supplier; every 4th clashes with an existing
    e-mail, every 10th (3 mod 10) repeats the previous row's e-mail."""
    k = F.col("s_suppkey")
    s = t.raw("supplier", "s_suppkey", "s_name")
    email = (F.when(k % 4 == 0, F.concat(F.lit("customer."), padded(k, 9), F.lit("@example.com")))
             .when(k % 10 == 3, F.concat(F.lit("supplier."), (k - 1).cast("string"), F.lit("@example.com")))
             .otherwise(F.concat(F.lit("supplier."), k.cast("string"), F.lit("@example.com"))))
    return s.select(k.cast("bigint").alias("seq"), F.lit("Supplier").alias("first_name"),
                    F.col("s_name").alias("last_name"), email.alias("email"),
                    F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("address"),
                    F.lit("Subscriber").alias("role"))


def user_updates(t: Tables) -> DataFrame:
    """One per user; every 50th takes the next user's e-mail (clash), every 97th an unknown id."""
    u = t.users
    nxt = u.select((F.col("user_id") - 1).alias("user_id"), F.col("email").alias("next_email"))
    uid = F.col("user_id")
    j = u.join(nxt, "user_id", "left")
    return j.select(
        uid.cast("bigint").alias("seq"), _shift_unknown(uid, uid % 97 == 5).alias("user_id"),
        F.initcap("first_name").alias("first_name"), "last_name",
        F.when((uid % 50 == 7) & F.col("next_email").isNotNull(), F.col("next_email")).otherwise(F.col("email")).alias("email"),
        "phone", F.concat(F.lit("Street "), uid.cast("string")).alias("address"), "role")


def user_deletes(t: Tables) -> DataFrame:
    uid = F.col("user_id")
    return t.users.select(uid.cast("bigint").alias("seq"), _shift_unknown(uid, uid % 97 == 5).alias("user_id"),
                          (uid - uid % 10).alias("actor_user_id"))


def subscribes(t: Tables) -> DataFrame:
    """One per user; every 23rd an unknown user, every 19th an unknown plan."""
    uid = F.col("user_id")
    return t.users.select(
        uid.cast("bigint").alias("seq"),
        F.when(uid % 23 == 0, -uid - 1).otherwise(uid).alias("user_id"),
        F.when(uid % 19 == 0, F.lit(-1)).otherwise((uid * 7) % t.plans.select(F.count(F.lit(1))).scalar()).alias("plan_id"),
        F.when(uid % 3 == 0, "PayPal").otherwise("Credit Card").alias("payment_method"),
        (uid % 2 == 0).alias("auto_renew"))


def renewals(t: Tables) -> DataFrame:
    """One per subscription; every 35th (1 mod 35) names the wrong owner."""
    sid = F.col("subscription_id")
    return t.subscriptions.select(
        sid.cast("bigint").alias("seq"), "subscription_id",
        F.when(sid % 35 == 1, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.lit("PayPal").alias("payment_method"))


def cancels(t: Tables) -> DataFrame:
    """One per subscription; every 35th names the wrong owner."""
    sid = F.col("subscription_id")
    return t.subscriptions.select(
        sid.cast("bigint").alias("seq"), "subscription_id",
        F.when(sid % 35 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))


def refunds(t: Tables) -> DataFrame:
    """One per payment; every 97th names an unknown payment."""
    pid = F.col("payment_id")
    return t.payments.select(pid.cast("bigint").alias("seq"),
                             F.when(pid % 97 == 0, -pid).otherwise(pid).alias("payment_id"))


def payment_records(t: Tables) -> DataFrame:
    """C11: one payment per subscription; every 101st an unknown subscription, every 9th Failed."""
    sid = F.col("subscription_id")
    return t.subscriptions.select(
        sid.cast("bigint").alias("seq"), _shift_unknown(sid, sid % 101 == 0).alias("subscription_id"),
        ((sid % 500) + F.lit(0.99)).cast(S.MONEY).alias("amount"),
        F.when(sid % 3 == 0, "PayPal").otherwise("Credit Card").alias("method"),
        F.when(sid % 9 == 0, "Failed").otherwise("Completed").alias("status"))


def status_changes(t: Tables) -> DataFrame:
    """C14: one per subscription; 'Paused' (invalid) on 3 mod 20."""
    sid = F.col("subscription_id")
    return t.subscriptions.select(
        sid.cast("bigint").alias("seq"), "subscription_id",
        F.when(sid % 20 == 3, "Paused").when(sid % 3 == 0, "Active").otherwise("Expired").alias("new_status"))


SQL = {
    "plan_cmd": """
SELECT CAST(plan_id AS BIGINT) AS seq,
       CASE WHEN plan_id % 2 = 0 THEN name ELSE concat('New plan #', CAST(plan_id AS VARCHAR)) END AS name,
       description, CAST(price + 1 AS DECIMAL(10,2)) AS price, 'Yearly' AS billing_cycle, 365 AS duration_days, features
FROM plans""",
    "plan_update_cmd": """
SELECT CAST(p.plan_id AS BIGINT) AS seq,
       CASE WHEN p.plan_id % 97 = 5 THEN -p.plan_id - 1 ELSE p.plan_id END AS plan_id,
       CASE WHEN p.plan_id % 50 = 7 AND n.name IS NOT NULL THEN n.name ELSE p.name END AS name,
       concat(COALESCE(p.description, ''), ' (v2)') AS description,
       CAST(p.price + 2 AS DECIMAL(10,2)) AS price, p.billing_cycle, p.duration_days, p.features
FROM plans p LEFT JOIN plans n ON n.plan_id - 1 = p.plan_id""",
    "plan_delete_cmd": """
SELECT CAST(plan_id AS BIGINT) AS seq, CASE WHEN plan_id % 97 = 5 THEN -plan_id - 1 ELSE plan_id END AS plan_id
FROM plans""",
    "bulk_users": """
SELECT CAST(s_suppkey AS BIGINT) AS seq, 'Supplier' AS first_name, s_name AS last_name,
       CASE WHEN s_suppkey % 4 = 0 THEN concat('customer.', lpad(CAST(s_suppkey AS VARCHAR), greatest(9, length(CAST(s_suppkey AS VARCHAR)))::INTEGER, '0'), '@example.com')
            WHEN s_suppkey % 10 = 3 THEN concat('supplier.', CAST(s_suppkey - 1 AS VARCHAR), '@example.com')
            ELSE concat('supplier.', CAST(s_suppkey AS VARCHAR), '@example.com') END AS email,
       CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS address, 'Subscriber' AS role
FROM supplier""",
    "user_update_cmd": """
SELECT CAST(u.user_id AS BIGINT) AS seq,
       CASE WHEN u.user_id % 97 = 5 THEN -u.user_id - 1 ELSE u.user_id END AS user_id,
       concat(upper(substr(u.first_name, 1, 1)), lower(substr(u.first_name, 2))) AS first_name, u.last_name,
       CASE WHEN u.user_id % 50 = 7 AND n.email IS NOT NULL THEN n.email ELSE u.email END AS email,
       u.phone, concat('Street ', CAST(u.user_id AS VARCHAR)) AS address, u.role
FROM users u LEFT JOIN users n ON n.user_id - 1 = u.user_id""",
    "user_delete_cmd": """
SELECT CAST(user_id AS BIGINT) AS seq, CASE WHEN user_id % 97 = 5 THEN -user_id - 1 ELSE user_id END AS user_id,
       user_id - user_id % 10 AS actor_user_id
FROM users""",
    "subscribe_cmd": """
SELECT CAST(user_id AS BIGINT) AS seq, CASE WHEN user_id % 23 = 0 THEN -user_id - 1 ELSE user_id END AS user_id,
       CASE WHEN user_id % 19 = 0 THEN -1 ELSE (user_id * 7) % (SELECT count(*) FROM plans) END AS plan_id,
       CASE WHEN user_id % 3 = 0 THEN 'PayPal' ELSE 'Credit Card' END AS payment_method, user_id % 2 = 0 AS auto_renew
FROM users""",
    "renew_cmd": """
SELECT CAST(subscription_id AS BIGINT) AS seq, subscription_id,
       CASE WHEN subscription_id % 35 = 1 THEN user_id + 1 ELSE user_id END AS user_id, 'PayPal' AS payment_method
FROM subscriptions""",
    "cancel_cmd": """
SELECT CAST(subscription_id AS BIGINT) AS seq, subscription_id,
       CASE WHEN subscription_id % 35 = 0 THEN user_id + 1 ELSE user_id END AS user_id
FROM subscriptions""",
    "refund_cmd": """
SELECT CAST(payment_id AS BIGINT) AS seq, CASE WHEN payment_id % 97 = 0 THEN -payment_id ELSE payment_id END AS payment_id
FROM payments""",
    "payment_cmd": """
SELECT CAST(subscription_id AS BIGINT) AS seq,
       CASE WHEN subscription_id % 101 = 0 THEN -subscription_id - 1 ELSE subscription_id END AS subscription_id,
       CAST((subscription_id % 500) + 0.99 AS DECIMAL(10,2)) AS amount,
       CASE WHEN subscription_id % 3 = 0 THEN 'PayPal' ELSE 'Credit Card' END AS method,
       CASE WHEN subscription_id % 9 = 0 THEN 'Failed' ELSE 'Completed' END AS status
FROM subscriptions""",
    "status_cmd": """
SELECT CAST(subscription_id AS BIGINT) AS seq, subscription_id,
       CASE WHEN subscription_id % 20 = 3 THEN 'Paused' WHEN subscription_id % 3 = 0 THEN 'Active' ELSE 'Expired' END AS new_status
FROM subscriptions""",
}


def mixed_commands(t: Tables) -> DataFrame:
    """Renew and cancel commands for every subscription in one batch: even
    ids renew then cancel, odd ids cancel then renew, and every subscription
    gets a second renewal after both (naming the right owner for every
    third id, a wrong owner otherwise); every 35th cancel names the wrong owner."""
    sid = F.col("subscription_id")
    s = t.subscriptions.select("subscription_id", "user_id")
    renew = s.select((sid * 4 + F.when(sid % 2 == 0, 0).otherwise(2)).cast("bigint").alias("seq"), F.lit("renew").alias("kind"),
                     "subscription_id", "user_id")
    cancel = s.select((sid * 4 + 1).cast("bigint").alias("seq"), F.lit("cancel").alias("kind"), "subscription_id",
                      F.when(sid % 35 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    again = s.select((sid * 4 + 3).cast("bigint").alias("seq"), F.lit("renew").alias("kind"), "subscription_id",
                     F.when(sid % 3 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"))
    return renew.unionByName(cancel).unionByName(again).withColumn("payment_method", F.lit("PayPal"))


SQL["mixed_cmd"] = """
SELECT CAST(subscription_id * 4 + CASE WHEN subscription_id % 2 = 0 THEN 0 ELSE 2 END AS BIGINT) AS seq, 'renew' AS kind,
       subscription_id, user_id, 'PayPal' AS payment_method FROM subscriptions
UNION ALL
SELECT CAST(subscription_id * 4 + 1 AS BIGINT), 'cancel', subscription_id,
       CASE WHEN subscription_id % 35 = 0 THEN user_id + 1 ELSE user_id END, 'PayPal' FROM subscriptions
UNION ALL
SELECT CAST(subscription_id * 4 + 3 AS BIGINT), 'renew', subscription_id,
       CASE WHEN subscription_id % 3 = 0 THEN user_id ELSE user_id + 1 END, 'PayPal' FROM subscriptions"""
