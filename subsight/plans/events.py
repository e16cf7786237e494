"""Registered outbox, webhook, rate-limit and sink queries."""

from pyspark.sql import functions as F

from ..operators import outbox as O
from ..operators import ratelimit as RL
from ..operators import webhooks as W
from ..sources import commands as C
from .registry import AS_OF, HMAC_TEST_KEY, query

A = f"TIMESTAMP '{AS_OF}'"
_PENDING = "processed_at IS NULL AND attempts < 5"
_OUTBOX_COLS = "outbox_id, type, payload, created_at, processed_at, attempts, error"


@query("outbox_pending", f"SELECT {_OUTBOX_COLS} FROM outbox_messages WHERE {_PENDING}")
def outbox_pending(t):
    """pending outbox rows."""
    return O.pending(t.outbox)


@query("outbox_dead_letter", f"SELECT {_OUTBOX_COLS} FROM outbox_messages WHERE processed_at IS NULL AND attempts >= 5")
def outbox_dead_letter(t):
    """exhausted outbox rows."""
    return O.dead_letter(t.outbox)


@query("outbox_batch", f"SELECT {_OUTBOX_COLS} FROM outbox_messages WHERE {_PENDING} ORDER BY created_at, outbox_id LIMIT 50")
def outbox_batch(t):
    """The next poll - oldest 50 pending rows."""
    return O.next_batch(t.outbox)


_DISPATCH = f"""
WITH p AS (
  SELECT o.*, json_valid(payload) AS json_ok,
         CASE WHEN json_valid(payload) THEN NULLIF(COALESCE(CAST(json_extract(payload, '$.UserId') AS BIGINT), 0), 0) END AS uid
  FROM outbox_messages o WHERE {_PENDING}),
d AS (
  SELECT p.*, CASE WHEN type IN ('PaymentProcessed', 'PaymentRefunded') AND NOT json_ok THEN 'Payload is not valid JSON.'
                   WHEN type = 'PaymentProcessed' AND uid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = p.uid)
                   THEN concat('Log user ', CAST(uid AS VARCHAR), ' does not exist.') END AS error_text
  FROM p)"""


@query("outbox_dispatch", _DISPATCH + """
SELECT outbox_id, type, CASE WHEN error_text IS NULL THEN 'processed' ELSE 'failed' END AS result, uid AS user_id,
       CASE WHEN error_text IS NULL AND type = 'PaymentProcessed' THEN 'Payment received'
            WHEN error_text IS NULL AND type = 'PaymentRefunded' THEN 'Payment refunded' END AS subject,
       CASE WHEN error_text IS NULL THEN attempts ELSE attempts + 1 END AS attempts
FROM d""")
def outbox_dispatch(t):
    """ST3: one dispatch pass over every pending row."""
    return O.dispatch(t.outbox, t.users, AS_OF)["results"]


@query("outbox_apply", _DISPATCH + f"""
SELECT outbox_id, type, payload, created_at, CASE WHEN error_text IS NULL THEN {A} ELSE processed_at END AS processed_at,
       CASE WHEN error_text IS NULL THEN attempts ELSE attempts + 1 END AS attempts, substr(error_text, 1, 1000) AS error
FROM d""")
def outbox_apply(t):
    """Outbox rows after the pass (processed stamp or attempts + error)."""
    return O.dispatch(t.outbox, t.users, AS_OF)["outbox"]


@query("outbox_notifications", _DISPATCH + """
SELECT outbox_id, uid AS user_id, 'Email' AS type,
       CASE type WHEN 'PaymentProcessed' THEN 'Payment received' ELSE 'Payment refunded' END AS subject,
       'Email: ' || CASE type WHEN 'PaymentProcessed' THEN 'Payment received' ELSE 'Payment refunded' END AS log_message
FROM d WHERE error_text IS NULL AND type IN ('PaymentProcessed', 'PaymentRefunded')""")
def outbox_notifications(t):
    """ST2 batch form: notifications of one pass and their NotificationSent log text."""
    n = O.dispatch(t.outbox, t.users, AS_OF)["notifications"]
    return n.select("outbox_id", "user_id", "type", "subject",
                    F.concat(F.col("type"), F.lit(": "), F.col("subject")).alias("log_message"))


_WEBHOOK = """
WITH w AS (
  SELECT seq, received_at, client_key, CASE WHEN seq % 17 = 0 THEN NULL ELSE event_id END AS event_id,
         seq % 13 <> 0 AS sig_ok, raw_payload FROM webhook_inbound),
win AS (SELECT event_id, min(seq) AS seq FROM w WHERE COALESCE(trim(event_id), '') <> '' AND sig_ok GROUP BY event_id),
d AS (
  SELECT w.*, CASE WHEN COALESCE(trim(w.event_id), '') = '' THEN 'missing_event_id' WHEN NOT w.sig_ok THEN 'unauthorized'
                   WHEN win.seq IS NULL THEN 'duplicate' WHEN NOT json_valid(w.raw_payload) THEN 'malformed'
                   WHEN COALESCE(CASE WHEN json_valid(w.raw_payload) THEN json_extract_string(w.raw_payload, '$.status') END, 'Completed')
                        NOT IN ('Completed', 'Failed', 'Refunded') THEN 'invalid_status'
                   ELSE 'accepted' END AS disposition,
         CASE WHEN json_valid(w.raw_payload) THEN json_extract_string(w.raw_payload, '$.transactionId') END AS txn,
         CASE WHEN json_valid(w.raw_payload) THEN COALESCE(json_extract_string(w.raw_payload, '$.status'), 'Completed') END AS status
  FROM w LEFT JOIN win ON win.seq = w.seq),
t AS (
  SELECT d.*, CASE WHEN d.disposition = 'accepted' THEN pm.payment_id END AS target_payment_id
  FROM d LEFT JOIN payments pm ON pm.transaction_id = d.txn)"""


@query("webhook_ingest", _WEBHOOK + """
SELECT seq, event_id, disposition, target_payment_id FROM t""")
def webhook_ingest(t):
    """ST5: disposition of every inbound webhook request."""
    return W.ingest(W.signed_inbound(t, HMAC_TEST_KEY), t.payments, t.outbox, HMAC_TEST_KEY,
                    with_outbox=False)["dispositions"]


@query("webhook_events", _WEBHOOK + """
SELECT CAST(seq AS BIGINT) AS id, event_id, raw_payload, received_at, disposition = 'accepted' AS processed
FROM t WHERE disposition IN ('accepted', 'malformed', 'invalid_status')""")
def webhook_events(t):
    """The stored webhook events; malformed ones stay unprocessed."""
    return W.ingest(W.signed_inbound(t, HMAC_TEST_KEY), t.payments, t.outbox, HMAC_TEST_KEY,
                    with_outbox=False)["events"].drop("signature")


@query("webhook_apply", _WEBHOOK + """
SELECT target_payment_id AS payment_id, arg_max(status, seq) AS status, max(seq) AS seq
FROM t WHERE disposition = 'accepted' AND target_payment_id IS NOT NULL GROUP BY target_payment_id""")
def webhook_apply(t):
    """Payment status updates from accepted webhooks (last arrival wins)."""
    return W.ingest(W.signed_inbound(t, HMAC_TEST_KEY), t.payments, t.outbox, HMAC_TEST_KEY,
                    with_outbox=False)["payment_updates"]


@query("webhook_outbox", _WEBHOOK + """
SELECT CAST((SELECT max(outbox_id) FROM outbox_messages) + row_number() OVER (ORDER BY seq) AS BIGINT) AS outbox_id,
       CASE WHEN json_extract_string(raw_payload, '$.type') = 'payment.refunded' THEN 'PaymentRefunded' ELSE 'PaymentProcessed' END AS type,
       received_at AS created_at
FROM t WHERE disposition = 'accepted'""")
def webhook_outbox(t):
    """ST5: outbox rows written for accepted webhooks."""
    box = W.ingest(W.signed_inbound(t, HMAC_TEST_KEY), t.payments, t.outbox, HMAC_TEST_KEY)["outbox"]
    return box.select("outbox_id", "type", "created_at")


def _limit_sql(window: str, permits: int) -> str:
    return f"""
SELECT seq, client_key, window_start, rn <= {permits} AS admitted FROM (
  SELECT seq, client_key, time_bucket(INTERVAL '{window}', received_at) AS window_start,
         row_number() OVER (PARTITION BY client_key, time_bucket(INTERVAL '{window}', received_at) ORDER BY received_at, seq) AS rn
  FROM webhook_inbound)"""


@query("rate_limit_admit", _limit_sql("10 seconds", 30))
def rate_limit_admit(t):
    """ST6: 30 permits per 10 s per client (the reference's setting)."""
    r = t.webhook_inbound.select("seq", "client_key", "received_at")
    return RL.admit(r, "client_key", "received_at", "10 seconds", 30, ["received_at", "seq"], "seq").select(
        "seq", "client_key", "window_start", "admitted")


@query("rate_limit_admit_daily", _limit_sql("1 day", 5))
def rate_limit_admit_daily(t):
    """ST6 with 5 permits per day, so that the limit bites at test scale."""
    r = t.webhook_inbound.select("seq", "client_key", "received_at")
    return RL.admit(r, "client_key", "received_at", "1 day", 5, ["received_at", "seq"], "seq").select(
        "seq", "client_key", "window_start", "admitted")


@query("append_logs", f"""
SELECT log_id, user_id, action, message, log_date FROM logs
UNION ALL
SELECT CAST((SELECT max(log_id) FROM logs) + row_number() OVER (ORDER BY subscription_id) AS BIGINT), user_id,
       'SubscriptionExpired', concat('Subscription ', CAST(subscription_id AS VARCHAR), ' expired.'), {A}
FROM subscriptions WHERE status = 'Active' AND end_date <= {A}""")
def append_logs(t):
    """The expiry job's log rows appended to a copy of the log table (ids continue it)."""
    from ..operators import subscription_jobs as SJ
    from ..session import scratch_path
    from ..sources.sinks import append_with_ids
    msgs = SJ.expire_due(t.subscriptions, AS_OF).logs
    new = msgs.select("subscription_id", "user_id", "action", "message", F.col("timestamp_utc").alias("log_date"))
    out = append_with_ids(scratch_path(t.spark, "logs-table"), t.logs, new, "log_id", ["subscription_id"])
    return out.select("log_id", "user_id", "action", "message", "log_date")


@query("append_outbox", f"""
SELECT outbox_id, type, payload, created_at, processed_at, attempts, error FROM outbox_messages
UNION ALL
SELECT CAST((SELECT max(outbox_id) FROM outbox_messages) + row_number() OVER (ORDER BY seq) AS BIGINT), 'PaymentProcessed',
       concat('{{"UserId":0,"SubscriptionId":', CAST(subscription_id AS VARCHAR), ',"PaymentId":',
              CAST((SELECT max(payment_id) FROM payments) + row_number() OVER (ORDER BY seq) AS VARCHAR),
              ',"Amount":', CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR), '}}'),
       {A}, CAST(NULL AS TIMESTAMP), 0, CAST(NULL AS VARCHAR)
FROM payment_cmd c WHERE EXISTS (SELECT 1 FROM subscriptions s WHERE s.subscription_id = c.subscription_id)""",
       ctes={"payment_cmd": C.SQL["payment_cmd"]})
def append_outbox(t):
    """Outbox rows of recorded payments appended to a copy of the outbox table."""
    from ..operators import payment_jobs as PJ
    from ..session import scratch_path
    from ..sources.sinks import append_with_ids
    box = PJ.record_payments(t.subscriptions, t.payments, t.outbox, C.payment_records(t), AS_OF).outbox
    new = box.drop("outbox_id").withColumn("_o", F.get_json_object("payload", "$.PaymentId").cast("long"))
    return append_with_ids(scratch_path(t.spark, "outbox-table"), t.outbox, new, "outbox_id", ["_o"], cast="bigint")
