"""Registered effects of the change jobs: the rows, logs and notifications
that each writes, and the number of rows it accepts (A11)."""

from pyspark.sql import functions as F

from ..operators import payment_jobs as PJ
from ..operators import plan_jobs as PL
from ..operators import subscription_jobs as SJ
from ..operators import user_jobs as UJ
from ..operators import webhooks as W
from ..sources import commands as C
from . import changes  # noqa: F401  (registers the outcomes that the SQL below starts from)
from .registry import AS_OF, HMAC_TEST_KEY, REGISTRY, query

A = f"TIMESTAMP '{AS_OF}'"
_JOBS = {
    "subscribe_batch": lambda t: SJ.subscribe(t.users, t.plans, t.subscriptions, t.payments, C.subscribes(t), AS_OF),
    "renew_batch": lambda t: SJ.renew(t.subscriptions, t.plans, t.payments, C.renewals(t), AS_OF),
    "cancel_batch": lambda t: SJ.cancel(t.subscriptions, t.plans, t.payments, C.cancels(t), AS_OF),
    "refund_batch": lambda t: PJ.refund(t.payments, t.subscriptions, t.plans, C.refunds(t), AS_OF),
    "set_status": lambda t: SJ.set_status(t.subscriptions, C.status_changes(t)),
    "upsert_plans": lambda t: PL.upsert(t.plans, C.plan_upserts(t), AS_OF),
    "update_plans": lambda t: PL.update(t.plans, C.plan_updates(t), AS_OF),
    "update_users": lambda t: UJ.update(t.users, C.user_updates(t), AS_OF),
}


def _outcome(job: str) -> str:
    return f"(SELECT * FROM ({REGISTRY[job].sql}) WHERE accepted)"


def _cmd(*names: str) -> dict[str, str]:
    return {n: C.SQL[n] for n in names}


@query("subscribe_rows", f"""
SELECT o.subscription_id, o.user_id, o.plan_id, {A} AS start_date, o.end_date, CAST(NULL AS TIMESTAMP) AS renewal_date, 'Active' AS status, c.auto_renew
FROM {_outcome("subscribe_batch")} o JOIN subscribe_cmd c ON c.seq = o.seq""", _cmd("subscribe_cmd"))
def subscribe_rows(t):
    """The new subscriptions."""
    return _JOBS["subscribe_batch"](t).upserts["subscriptions"]


@query("subscribe_payments", f"""
SELECT o.payment_id, o.subscription_id, o.amount, {A} AS payment_date, c.payment_method, 'Completed' AS status
FROM {_outcome("subscribe_batch")} o JOIN subscribe_cmd c ON c.seq = o.seq""", _cmd("subscribe_cmd"))
def subscribe_payments(t):
    """Their payments (transaction ids are hashes; tests check that they are unique)."""
    return _JOBS["subscribe_batch"](t).upserts["payments"].drop("transaction_id")


@query("renew_rows", f"""
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, max(o.new_end) AS end_date, {A} AS renewal_date, 'Active' AS status, s.auto_renew
FROM {_outcome("renew_batch")} o JOIN subscriptions s ON s.subscription_id = o.subscription_id
GROUP BY s.subscription_id, s.user_id, s.plan_id, s.start_date, s.auto_renew""")
def renew_rows(t):
    """The renewed subscriptions."""
    return _JOBS["renew_batch"](t).upserts["subscriptions"]


@query("cancel_rows", f"""
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, {A} AS end_date, s.renewal_date, 'Cancelled' AS status, false AS auto_renew
FROM {_outcome("cancel_batch")} o JOIN subscriptions s ON s.subscription_id = o.subscription_id""")
def cancel_rows(t):
    """The cancelled subscriptions."""
    return _JOBS["cancel_batch"](t).upserts["subscriptions"]


@query("cancel_payments", f"""
SELECT p.payment_id, p.subscription_id, p.amount, p.payment_date, p.payment_method, p.transaction_id, 'Refunded' AS status
FROM {_outcome("cancel_batch")} o JOIN payments p ON p.payment_id = o.refunded_payment_id""")
def cancel_payments(t):
    """The payments that cancelling refunds."""
    return _JOBS["cancel_batch"](t).upserts["payments"]


@query("refund_payments", f"""
SELECT p.payment_id, p.subscription_id, p.amount, p.payment_date, p.payment_method, p.transaction_id, 'Refunded' AS status
FROM payments p WHERE EXISTS (SELECT 1 FROM refund_cmd c WHERE c.payment_id = p.payment_id)""", _cmd("refund_cmd"))
def refund_payments(t):
    """The refunded payments."""
    return _JOBS["refund_batch"](t).upserts["payments"]


@query("refund_subscriptions", f"""
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, CASE WHEN s.status = 'Active' THEN {A} ELSE s.end_date END AS end_date,
       s.renewal_date, CASE WHEN s.status = 'Active' THEN 'Cancelled' ELSE s.status END AS status, false AS auto_renew
FROM subscriptions s WHERE EXISTS (
  SELECT 1 FROM payments p JOIN refund_cmd c ON c.payment_id = p.payment_id WHERE p.subscription_id = s.subscription_id)""", _cmd("refund_cmd"))
def refund_subscriptions(t):
    """The subscriptions of refunded payments."""
    return _JOBS["refund_batch"](t).upserts["subscriptions"]


@query("set_status_rows", """
SELECT s.subscription_id, s.user_id, s.plan_id, s.start_date, s.end_date, s.renewal_date, c.new_status AS status, s.auto_renew
FROM status_cmd c JOIN subscriptions s ON s.subscription_id = c.subscription_id
WHERE c.new_status IN ('Active', 'Cancelled', 'Expired')""", _cmd("status_cmd"))
def set_status_rows(t):
    """C14: the changed subscriptions."""
    return _JOBS["set_status"](t).upserts["subscriptions"]


@query("upsert_plans_rows", f"""
SELECT o.plan_id, COALESCE(p.name, o.name) AS name, c.description, c.price, c.billing_cycle, c.duration_days, c.features,
       COALESCE(p.created_at, {A}) AS created_at, CASE WHEN p.plan_id IS NOT NULL THEN {A} END AS updated_at
FROM {_outcome("upsert_plans")} o JOIN plan_cmd c ON c.seq = o.seq LEFT JOIN plans p ON p.plan_id = o.plan_id""", _cmd("plan_cmd"))
def upsert_plans_rows(t):
    """Inserted and updated plans."""
    return _JOBS["upsert_plans"](t).upserts["plans"]


@query("update_plans_rows", f"""
SELECT o.plan_id, o.name, c.description, c.price, c.billing_cycle, c.duration_days, c.features, p.created_at, {A} AS updated_at
FROM {_outcome("update_plans")} o JOIN plan_update_cmd c ON c.seq = o.seq JOIN plans p ON p.plan_id = o.plan_id""", _cmd("plan_update_cmd"))
def update_plans_rows(t):
    """Updated plans."""
    return _JOBS["update_plans"](t).upserts["plans"]


@query("update_users_rows", f"""
SELECT o.user_id, c.first_name, c.last_name, c.email, c.phone, c.address, u.registration_date, c.role
FROM {_outcome("update_users")} o JOIN user_update_cmd c ON c.seq = o.seq JOIN users u ON u.user_id = o.user_id""", _cmd("user_update_cmd"))
def update_users_rows(t):
    """Updated users."""
    return _JOBS["update_users"](t).upserts["users"]


@query("affected_rows", " UNION ALL ".join(
    f"SELECT '{job}' AS job, count(*)::BIGINT AS affected FROM {_outcome(job)}" for job in _JOBS))
def affected_rows(t):
    """Accepted commands of each job."""
    out = None
    for job, run in _JOBS.items():
        one = run(t).affected().select(F.lit(job).alias("job"), "affected")
        out = one if out is None else out.unionByName(one)
    return out


_ACTIONS = {"subscribe_batch": ["SubscriptionCreated", "PaymentProcessed"], "renew_batch": ["SubscriptionRenewed"],
            "cancel_batch": ["SubscriptionCancelled"], "update_users": ["UserUpdated"]}


@query("change_logs", " UNION ALL ".join(
    f"SELECT '{job}' AS job, user_id, '{a}' AS action, {A} AS timestamp_utc FROM {_outcome(job)}" for job, actions in _ACTIONS.items() for a in actions))
def change_logs(t):
    """The log rows of the jobs: who, what, when (log_text checks the texts)."""
    out = None
    for job in _ACTIONS:
        one = _JOBS[job](t).logs.select(F.lit(job).alias("job"), "user_id", "action", "timestamp_utc")
        out = one if out is None else out.unionByName(one)
    return out


@query("change_notifications", " UNION ALL ".join(
    f"SELECT '{job}' AS job, user_id, 'Email' AS type, {A} AS timestamp_utc FROM {_outcome(job)}" for job in ("subscribe_batch", "renew_batch", "cancel_batch")))
def change_notifications(t):
    """The notifications of the jobs (notification_text checks the texts)."""
    out = None
    for job in ("subscribe_batch", "renew_batch", "cancel_batch"):
        one = _JOBS[job](t).notifications.select(F.lit(job).alias("job"), "user_id", "type", "timestamp_utc")
        out = one if out is None else out.unionByName(one)
    return out


_BY_PAYMENT = """
SELECT seq, concat('pay-', CAST(seq AS VARCHAR)) AS event_id, (seq % (SELECT count(*) FROM orders)) * 10 + seq % 4 AS payment_id,
       CASE WHEN seq % 2 = 0 THEN 'Refunded' ELSE 'Failed' END AS status
FROM webhook_inbound"""


@query("webhook_by_payment_id", f"""
WITH w AS ({_BY_PAYMENT})
SELECT p.payment_id, arg_max(w.status, w.seq) AS status, max(w.seq) AS seq
FROM w JOIN payments p ON p.payment_id = w.payment_id GROUP BY p.payment_id""")
def webhook_by_payment_id(t):
    """Bodies without a transaction id find their payment by its id."""
    n = t.raw("orders").select(F.count(F.lit(1))).scalar()
    body = F.concat(F.lit('{"type":"payment.updated","paymentId":'), ((F.col("seq") % n) * 10 + F.col("seq") % 4).cast("string"),
                    F.lit(',"status":"'), F.when(F.col("seq") % 2 == 0, "Refunded").otherwise("Failed"), F.lit('"}'))
    w = t.webhook_inbound.select("seq", "received_at", "client_key", F.concat(F.lit("pay-"), F.col("seq").cast("string")).alias("event_id"),
                                 body.alias("raw_payload"))
    from ..functions.hmac import hmac_sha256_base64
    w = w.withColumn("signature", hmac_sha256_base64(F.col("raw_payload"), HMAC_TEST_KEY))
    return W.ingest(w, t.payments, t.outbox, HMAC_TEST_KEY, with_outbox=False)["payment_updates"]
