"""Registered change jobs (C1-C14, C18 inside): each returns the outcome
per command; the oracle states the same rules in SQL."""

from ..operators import payment_jobs as PJ
from ..operators import plan_jobs as PL
from ..operators import subscription_jobs as SJ
from ..operators import user_jobs as UJ
from ..sources import commands as C
from .registry import AS_OF, query

A = f"TIMESTAMP '{AS_OF}'"
_REM = "LEAST(GREATEST(date_diff('day', CAST({a} AS DATE), CAST({end} AS DATE)), 0), {dur})"


def _prorata(amount, rem, dur):
    return (f"CASE WHEN {dur} > 0 AND {rem} > 0 THEN CAST(((2 * CAST({amount} * 100 AS BIGINT) * {rem} + {dur}) "
            f"// (2 * {dur})) / 100.0 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END")


@query("bulk_users_input", """
SELECT seq, first_name, last_name, email, phone, address, role FROM bulk_users""",
       ctes={"bulk_users": C.SQL["bulk_users"]})
def bulk_users_input(t):
    """S3: the table-valued input rows, schema enforced."""
    return C.bulk_users(t)


@query("subscribe_batch", f"""
WITH j AS (
  SELECT c.seq, c.user_id, c.plan_id, c.auto_renew, p.price, p.duration_days,
         CASE WHEN u.user_id IS NULL THEN 'user_not_found' WHEN lower(u.role) = 'admin' THEN 'admin_cannot_subscribe'
              WHEN p.plan_id IS NULL THEN 'plan_not_found' END AS reason
  FROM subscribe_cmd c LEFT JOIN users u ON u.user_id = c.user_id LEFT JOIN plans p ON p.plan_id = c.plan_id),
ok AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM j WHERE reason IS NULL)
SELECT seq, user_id, plan_id, reason, CAST((SELECT max(subscription_id) FROM subscriptions) + rn AS BIGINT) AS subscription_id,
       CAST((SELECT max(payment_id) FROM payments) + rn AS BIGINT) AS payment_id,
       {A} + CAST(duration_days AS INTEGER) * INTERVAL '1' DAY AS end_date, price AS amount, true AS accepted FROM ok
UNION ALL
SELECT seq, user_id, plan_id, reason, NULL, NULL, NULL, NULL, false FROM j WHERE reason IS NOT NULL""",
       ctes={"subscribe_cmd": C.SQL["subscribe_cmd"]})
def subscribe_batch(t):
    """Subscribe commands -> new subscriptions and payments (ids continue the tables)."""
    return SJ.subscribe(t.users, t.plans, t.subscriptions, t.payments, C.subscribes(t), AS_OF).outcome


@query("renew_batch", f"""
WITH j AS (
  SELECT c.seq, c.subscription_id, c.user_id, s.end_date, p.duration_days,
         CASE WHEN s.subscription_id IS NULL THEN 'not_found' WHEN s.user_id <> c.user_id THEN 'not_owner'
              WHEN s.status = 'Cancelled' THEN 'cancelled' END AS reason
  FROM renew_cmd c LEFT JOIN subscriptions s ON s.subscription_id = c.subscription_id
  LEFT JOIN plans p ON p.plan_id = s.plan_id),
ok AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn,
              row_number() OVER (PARTITION BY subscription_id ORDER BY seq) AS k FROM j WHERE reason IS NULL)
SELECT seq, subscription_id, user_id, reason, CAST((SELECT max(payment_id) FROM payments) + rn AS BIGINT) AS payment_id,
       GREATEST(end_date, {A}) + CAST(duration_days * k AS INTEGER) * INTERVAL '1' DAY AS new_end, true AS accepted FROM ok
UNION ALL
SELECT seq, subscription_id, user_id, reason, NULL, NULL, false FROM j WHERE reason IS NOT NULL""",
       ctes={"renew_cmd": C.SQL["renew_cmd"]})
def renew_batch(t):
    """Renewals: new end, renewal date, Active, one payment each."""
    return SJ.renew(t.subscriptions, t.plans, t.payments, C.renewals(t), AS_OF).outcome


_CANCEL_REM = _REM.format(a=A, end="s.end_date", dur="p.duration_days")


@query("cancel_batch", f"""
WITH latest AS (
  SELECT subscription_id, payment_id FROM (
    SELECT subscription_id, payment_id,
           row_number() OVER (PARTITION BY subscription_id ORDER BY payment_date DESC, payment_id DESC) AS rn
    FROM payments WHERE status = 'Completed') WHERE rn = 1),
firsts AS (
  SELECT c.subscription_id, min(c.seq) AS first_seq FROM cancel_cmd c
  JOIN subscriptions s ON s.subscription_id = c.subscription_id AND s.user_id = c.user_id GROUP BY c.subscription_id),
j AS (
  SELECT c.seq, c.subscription_id, c.user_id, {_CANCEL_REM} AS rem, p.price, p.duration_days,
         CASE WHEN s.subscription_id IS NULL THEN 'not_found' WHEN s.user_id <> c.user_id THEN 'not_owner'
              WHEN s.status <> 'Active' THEN 'not_active' WHEN c.seq <> f.first_seq THEN 'not_active' END AS reason
  FROM cancel_cmd c LEFT JOIN subscriptions s ON s.subscription_id = c.subscription_id
  LEFT JOIN plans p ON p.plan_id = s.plan_id LEFT JOIN firsts f ON f.subscription_id = c.subscription_id),
ok AS (SELECT j.*, {_prorata('price', 'rem', 'duration_days')} AS refund_amount FROM j WHERE reason IS NULL)
SELECT ok.seq, ok.subscription_id, ok.user_id, ok.reason, CAST(ok.rem AS INTEGER) AS remaining_days, ok.refund_amount,
       CASE WHEN ok.refund_amount > 0 THEN l.payment_id END AS refunded_payment_id, true AS accepted
FROM ok LEFT JOIN latest l ON l.subscription_id = ok.subscription_id
UNION ALL
SELECT seq, subscription_id, user_id, reason, NULL, NULL, NULL, false FROM j WHERE reason IS NOT NULL""",
       ctes={"cancel_cmd": C.SQL["cancel_cmd"]})
def cancel_batch(t):
    """Cancellations with pro-rata refund and the refunded payment."""
    return SJ.cancel(t.subscriptions, t.plans, t.payments, C.cancels(t), AS_OF).outcome


@query("expire_due", f"""
SELECT subscription_id, user_id, plan_id, end_date, true AS accepted FROM subscriptions
WHERE status = 'Active' AND end_date <= {A}""")
def expire_due(t):
    """Subscriptions the expiry job moves to Expired."""
    return SJ.expire_due(t.subscriptions, AS_OF).outcome


@query("expiry_run_log", f"""
SELECT CAST(NULL AS BIGINT) AS user_id, 'ExpiryCheckRan' AS action,
       concat('Expired ', CAST(count(*) AS VARCHAR), ' subscription(s) at ', strftime({A}, '%Y-%m-%dT%H:%M:%S.%f'), '0Z') AS message,
       count(*) AS expired_count
FROM subscriptions WHERE status = 'Active' AND end_date <= {A}""")
def expiry_run_log(t):
    """ST4: the log row of one expiry run."""
    return SJ.expiry_run_log(t.subscriptions, AS_OF)


@query("set_status", """
SELECT c.seq, c.subscription_id, s.status AS old_status, c.new_status,
       CASE WHEN c.new_status NOT IN ('Active', 'Cancelled', 'Expired') THEN 'invalid_status'
            WHEN s.subscription_id IS NULL THEN 'not_found' END AS reason,
       (c.new_status IN ('Active', 'Cancelled', 'Expired') AND s.subscription_id IS NOT NULL) AS accepted
FROM status_cmd c LEFT JOIN subscriptions s ON s.subscription_id = c.subscription_id""",
       ctes={"status_cmd": C.SQL["status_cmd"]})
def set_status(t):
    """C14: status changes with value check."""
    return SJ.set_status(t.subscriptions, C.status_changes(t)).outcome


@query("record_payments", """
WITH j AS (
  SELECT c.seq, c.subscription_id, CASE WHEN s.subscription_id IS NULL THEN 'unknown_subscription' END AS reason
  FROM payment_cmd c LEFT JOIN subscriptions s ON s.subscription_id = c.subscription_id),
ok AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM j WHERE reason IS NULL)
SELECT seq, subscription_id, reason, CAST((SELECT max(payment_id) FROM payments) + rn AS BIGINT) AS payment_id,
       CAST((SELECT max(outbox_id) FROM outbox_messages) + rn AS BIGINT) AS outbox_id, true AS accepted FROM ok
UNION ALL
SELECT seq, subscription_id, reason, NULL, NULL, false FROM j WHERE reason IS NOT NULL""",
       ctes={"payment_cmd": C.SQL["payment_cmd"]})
def record_payments(t):
    """C11: recorded payments with their outbox rows."""
    return PJ.record_payments(t.subscriptions, t.payments, t.outbox, C.payment_records(t), AS_OF).outcome


_REFUND_END = f"CASE WHEN s.status = 'Active' AND c.seq <> fs.first_seq THEN {A} ELSE s.end_date END"
_REFUND_REM = _REM.format(a=A, end=_REFUND_END, dur="pl.duration_days")


@query("refund_batch", f"""
WITH fs AS (
  SELECT pm.subscription_id, min(c.seq) AS first_seq FROM refund_cmd c JOIN payments pm ON pm.payment_id = c.payment_id
  GROUP BY pm.subscription_id),
fp AS (SELECT payment_id, min(seq) AS first_seq FROM refund_cmd GROUP BY payment_id),
ok AS (
  SELECT c.seq, c.payment_id, pm.subscription_id, pm.amount, pm.status AS payment_status, s.status AS sub_status,
         pl.duration_days, {_REFUND_REM} AS rem, (pm.status = 'Refunded' OR c.seq <> fp.first_seq) AS already_refunded
  FROM refund_cmd c JOIN payments pm ON pm.payment_id = c.payment_id
  JOIN subscriptions s ON s.subscription_id = pm.subscription_id JOIN plans pl ON pl.plan_id = s.plan_id
  JOIN fs ON fs.subscription_id = pm.subscription_id JOIN fp ON fp.payment_id = c.payment_id)
SELECT seq, payment_id, subscription_id, CAST(NULL AS VARCHAR) AS reason, already_refunded, sub_status,
       CAST(rem AS INTEGER) AS remaining_days, {_prorata('amount', 'rem', 'duration_days')} AS refund_estimate, true AS accepted
FROM ok
UNION ALL
SELECT c.seq, c.payment_id, NULL, 'not_found', NULL, NULL, NULL, NULL, false
FROM refund_cmd c WHERE NOT EXISTS (SELECT 1 FROM payments pm WHERE pm.payment_id = c.payment_id)""",
       ctes={"refund_cmd": C.SQL["refund_cmd"]})
def refund_batch(t):
    """Refunds: payment Refunded, Active subscription cancelled, estimate from the end date seen."""
    return PJ.refund(t.payments, t.subscriptions, t.plans, C.refunds(t), AS_OF).outcome


@query("upsert_plans", """
WITH j AS (SELECT c.seq, c.name, p.plan_id AS match_id FROM plan_cmd c LEFT JOIN plans p ON lower(p.name) = lower(c.name))
SELECT seq, name, match_id AS plan_id, 'updated' AS action, true AS accepted FROM j WHERE match_id IS NOT NULL
UNION ALL
SELECT seq, name, CAST((SELECT max(plan_id) FROM plans) + row_number() OVER (ORDER BY seq) AS BIGINT), 'inserted', true
FROM j WHERE match_id IS NULL""", ctes={"plan_cmd": C.SQL["plan_cmd"]})
def upsert_plans(t):
    """MERGE by name: update matches, insert the rest with new ids."""
    return PL.upsert(t.plans, C.plan_upserts(t), AS_OF).outcome


@query("update_plans", """
SELECT c.seq, c.plan_id, c.name,
       CASE WHEN p.plan_id IS NULL THEN 'not_found'
            WHEN EXISTS (SELECT 1 FROM plans o WHERE lower(o.name) = lower(c.name) AND o.plan_id <> c.plan_id) THEN 'name_taken' END AS reason,
       p.plan_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM plans o WHERE lower(o.name) = lower(c.name) AND o.plan_id <> c.plan_id) AS accepted
FROM plan_update_cmd c LEFT JOIN plans p ON p.plan_id = c.plan_id""", ctes={"plan_update_cmd": C.SQL["plan_update_cmd"]})
def update_plans(t):
    """Plan updates; unknown ids and taken names rejected."""
    return PL.update(t.plans, C.plan_updates(t), AS_OF).outcome


def _handed_sql(table: str, key: str, value: str, reason: str) -> str:
    return f"""
WITH c AS (
  SELECT CAST(2 * t.{key} AS BIGINT) AS seq, t.{key}, CASE WHEN t.{key} % 10 = 3 AND n.{value} IS NOT NULL THEN n.{value} ELSE concat('freed.', t.{value}) END AS {value},
         t.{key} % 10 <> 3 OR n.{value} IS NULL AS accepted
  FROM {table} t LEFT JOIN {table} n ON n.{key} = t.{key} + 1
  UNION ALL
  SELECT CAST(2 * t.{key} + 1 AS BIGINT), t.{key}, p.{value}, p.{key} % 10 <> 3
  FROM {table} t JOIN {table} p ON p.{key} = t.{key} - 1 WHERE t.{key} % 10 <> 3)
SELECT seq, {key}, {value}, CASE WHEN NOT accepted THEN '{reason}' END AS reason, accepted FROM c"""


@query("update_plans_chain", _handed_sql("plans", "plan_id", "name", "name_taken"))
def update_plans_chain(t):
    """Names that one command gives up and a later one takes."""
    return PL.update(t.plans, C.plan_renames(t), AS_OF).outcome


@query("update_users_chain", _handed_sql("users", "user_id", "email", "email_taken"))
def update_users_chain(t):
    """E-mails that one command gives up and a later one takes."""
    return UJ.update(t.users, C.user_moves(t), AS_OF).outcome


@query("delete_plans", """
SELECT c.seq, c.plan_id,
       CASE WHEN p.plan_id IS NULL THEN 'not_found'
            WHEN EXISTS (SELECT 1 FROM subscriptions s WHERE s.plan_id = c.plan_id) THEN 'in_use' END AS reason,
       p.plan_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM subscriptions s WHERE s.plan_id = c.plan_id) AS accepted
FROM plan_delete_cmd c LEFT JOIN plans p ON p.plan_id = c.plan_id""", ctes={"plan_delete_cmd": C.SQL["plan_delete_cmd"]})
def delete_plans(t):
    """Guarded plan deletes."""
    return PL.delete(t.plans, t.subscriptions, C.plan_deletes(t), AS_OF).outcome


_REGISTER_J = """
SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(b.email)) THEN 'email_taken'
                 WHEN b.seq <> (SELECT min(x.seq) FROM bulk_users x WHERE lower(x.email) = lower(b.email)) THEN 'email_taken' END AS reason
FROM bulk_users b"""


@query("register_users", """
WITH ok AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM j WHERE reason IS NULL)
SELECT seq, email, CAST((SELECT max(user_id) FROM users) + rn AS BIGINT) AS user_id, reason, true AS accepted FROM ok
UNION ALL SELECT seq, email, NULL, reason, false FROM j WHERE reason IS NOT NULL""",
       ctes={"bulk_users": C.SQL["bulk_users"], "j": _REGISTER_J})
def register_users(t):
    """C4: registrations; e-mails in use (or repeated in the batch) rejected."""
    return UJ.register(t.users, C.bulk_users(t), AS_OF).outcome


@query("bulk_insert_users", f"""
SELECT CAST((SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY seq) AS BIGINT) AS user_id,
       first_name, last_name, email, phone, address, {A} AS registration_date,
       CASE WHEN COALESCE(trim(role), '') = '' THEN 'Subscriber' ELSE role END AS role
FROM j WHERE reason IS NULL""", ctes={"bulk_users": C.SQL["bulk_users"], "j": _REGISTER_J})
def bulk_insert_users(t):
    """Bulk insert of the table-valued input after e-mail dedup."""
    return UJ.bulk_insert(t.users, C.bulk_users(t), AS_OF)


@query("update_users", """
SELECT c.seq, c.user_id, c.email,
       CASE WHEN u.user_id IS NULL THEN 'not_found'
            WHEN EXISTS (SELECT 1 FROM users o WHERE lower(o.email) = lower(c.email) AND o.user_id <> c.user_id) THEN 'email_taken' END AS reason,
       u.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users o WHERE lower(o.email) = lower(c.email) AND o.user_id <> c.user_id) AS accepted
FROM user_update_cmd c LEFT JOIN users u ON u.user_id = c.user_id""", ctes={"user_update_cmd": C.SQL["user_update_cmd"]})
def update_users(t):
    """Profile updates; e-mail clashes rejected."""
    return UJ.update(t.users, C.user_updates(t), AS_OF).outcome


@query("delete_users", """
SELECT c.seq, c.user_id,
       CASE WHEN u.user_id IS NULL THEN 'not_found'
            WHEN EXISTS (SELECT 1 FROM subscriptions s WHERE s.user_id = c.user_id) THEN 'in_use' END AS reason,
       u.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM subscriptions s WHERE s.user_id = c.user_id) AS accepted
FROM user_delete_cmd c LEFT JOIN users u ON u.user_id = c.user_id""", ctes={"user_delete_cmd": C.SQL["user_delete_cmd"]})
def delete_users(t):
    """Guarded user deletes."""
    return UJ.delete(t.users, t.subscriptions, C.user_deletes(t), AS_OF).outcome



_MIXED_REM = _REM.format(a=A, end="end_seen", dur="dur")


@query("mixed_subscription_batch", f"""
WITH j AS (
  SELECT c.seq, c.kind, c.subscription_id, c.user_id, s.user_id AS owner, s.end_date AS end0, s.status AS st0,
         p.price, p.duration_days AS dur, s.user_id = c.user_id AS own
  FROM mixed_cmd c LEFT JOIN subscriptions s ON s.subscription_id = c.subscription_id
  LEFT JOIN plans p ON p.plan_id = s.plan_id),
fr AS (SELECT subscription_id, min(seq) AS first_renew FROM j WHERE own AND kind = 'renew' GROUP BY subscription_id),
j2 AS (SELECT j.*, CASE WHEN st0 = 'Active' THEN -1 ELSE fr.first_renew END AS active_from
       FROM j LEFT JOIN fr ON fr.subscription_id = j.subscription_id),
ca AS (SELECT subscription_id, min(seq) AS cancel_seq FROM j2
       WHERE own AND kind = 'cancel' AND st0 <> 'Cancelled' AND active_from IS NOT NULL AND seq > active_from
       GROUP BY subscription_id),
r AS (SELECT j2.*, ca.cancel_seq,
             CASE WHEN owner IS NULL THEN 'not_found' WHEN NOT own THEN 'not_owner'
                  WHEN kind = 'renew' AND (st0 = 'Cancelled' OR (ca.cancel_seq IS NOT NULL AND seq > ca.cancel_seq)) THEN 'cancelled'
                  WHEN kind <> 'renew' AND (ca.cancel_seq IS NULL OR seq <> ca.cancel_seq) THEN 'not_active' END AS reason
      FROM j2 LEFT JOIN ca ON ca.subscription_id = j2.subscription_id),
rn AS (SELECT r.*, row_number() OVER (PARTITION BY subscription_id ORDER BY seq) AS k,
              CAST((SELECT max(payment_id) FROM payments) + row_number() OVER (ORDER BY seq) AS BIGINT) AS payment_id
       FROM r WHERE reason IS NULL AND kind = 'renew'),
rn2 AS (SELECT rn.*, GREATEST(end0, {A}) + CAST(dur * k AS INTEGER) * INTERVAL '1' DAY AS new_end FROM rn),
lastr AS (SELECT subscription_id, arg_max(new_end, k) AS last_end, arg_max(payment_id, k) AS last_pid
          FROM rn2 GROUP BY subscription_id),
latest AS (
  SELECT subscription_id, payment_id, payment_date FROM (
    SELECT subscription_id, payment_id, payment_date,
           row_number() OVER (PARTITION BY subscription_id ORDER BY payment_date DESC, payment_id DESC) AS rnk
    FROM payments WHERE status = 'Completed') WHERE rnk = 1),
cx AS (SELECT r.*, COALESCE(lastr.last_end, r.end0) AS end_seen, lastr.last_pid
       FROM r LEFT JOIN lastr ON lastr.subscription_id = r.subscription_id WHERE r.reason IS NULL AND r.kind = 'cancel'),
cx2 AS (SELECT cx.*, {_MIXED_REM} AS rem FROM cx),
cx3 AS (SELECT cx2.*, {_prorata('price', 'rem', 'dur')} AS refund_amount FROM cx2)
SELECT seq, kind, subscription_id, user_id, reason, payment_id, new_end, CAST(NULL AS DECIMAL(18,2)) AS refund_amount,
       CAST(NULL AS BIGINT) AS refunded_payment_id, true AS accepted FROM rn2
UNION ALL
SELECT cx3.seq, cx3.kind, cx3.subscription_id, cx3.user_id, cx3.reason, NULL, NULL, cx3.refund_amount,
       CASE WHEN cx3.refund_amount > 0 THEN
            CASE WHEN cx3.last_pid IS NOT NULL AND (latest.payment_date IS NULL OR {A} > latest.payment_date
                      OR ({A} = latest.payment_date AND cx3.last_pid > latest.payment_id))
                 THEN cx3.last_pid ELSE latest.payment_id END END, true
FROM cx3 LEFT JOIN latest ON latest.subscription_id = cx3.subscription_id
UNION ALL
SELECT seq, kind, subscription_id, user_id, reason, NULL, NULL, NULL, NULL, false FROM r WHERE reason IS NOT NULL""",
       ctes={"mixed_cmd": C.SQL["mixed_cmd"]})
def mixed_subscription_batch(t):
    """Renewals and cancellations of the same subscriptions in one batch, as serial processing would decide them."""
    return SJ.mixed(t.subscriptions, t.plans, t.payments, C.mixed_commands(t), AS_OF).outcome
