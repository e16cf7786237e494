"""Registered stream queries: each lands rows derived from the tables, runs
the Structured Streaming job to completion (availableNow) and returns its
sink. A stream must equal the batch job, so the oracle is the batch SQL."""

from pyspark.sql import functions as F

from ..operators import outbox as O
from ..operators import webhooks as W
from ..sources import schemas as S
from ..streaming import jobs as SJ
from ..streaming.landing import files_a_batch, land
from .events import _DISPATCH, _WEBHOOK, _limit_sql
from .registry import AS_OF, HMAC_TEST_KEY, query


def _conform(df, schema):
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@query("stream_logs", """
SELECT user_id, action, message, log_date AS timestamp_utc,
       CASE WHEN user_id IS NULL OR EXISTS (SELECT 1 FROM users u WHERE u.user_id = l.user_id) THEN 'logs' ELSE 'quarantine' END AS sink
FROM logs l""")
def stream_logs(t):
    """ST1: log messages streamed into the log sink (unknown users quarantined)."""
    msgs = _conform(t.logs.select("user_id", "action", "message", F.col("log_date").alias("timestamp_utc")), S.LOG_MESSAGE)
    path = land(msgs.withColumn("_o", F.unix_micros(F.col("timestamp_utc").cast("timestamp"))), "logs", "_o")
    return SJ.logs_stream(t.spark, path, t.users, files_per_trigger=files_a_batch(t.spark, path))


@query("stream_notifications", _DISPATCH + f"""
SELECT uid AS user_id, 'NotificationSent' AS action,
       'Email: ' || CASE type WHEN 'PaymentProcessed' THEN 'Payment received' ELSE 'Payment refunded' END AS message,
       TIMESTAMP '{AS_OF}' AS timestamp_utc
FROM d WHERE error_text IS NULL AND type IN ('PaymentProcessed', 'PaymentRefunded')""")
def stream_notifications(t):
    """ST2: notifications of an outbox pass, streamed to delivery + NotificationSent logs."""
    n = O.dispatch(t.outbox, t.users, AS_OF)["notifications"]
    path = land(n, "notifications", "outbox_id")
    return SJ.notifications_stream(t.spark, path, files_per_trigger=files_a_batch(t.spark, path))


@query("stream_outbox", _DISPATCH + """
SELECT outbox_id, type, CASE WHEN error_text IS NULL THEN 'processed' ELSE 'failed' END AS result, uid AS user_id,
       CASE WHEN error_text IS NULL AND type = 'PaymentProcessed' THEN 'Payment received'
            WHEN error_text IS NULL AND type = 'PaymentRefunded' THEN 'Payment refunded' END AS subject,
       CASE WHEN error_text IS NULL THEN attempts ELSE 5 END AS attempts
FROM d""")
def stream_outbox(t):
    """ST3: outbox rows streamed through the dispatcher; failed ones are tried until 5 attempts are used."""
    return SJ.outbox_final(t.spark, _outbox_sink(t), "results")


@query("stream_outbox_rows", _DISPATCH + f"""
SELECT outbox_id, type, payload, created_at, CASE WHEN error_text IS NULL THEN TIMESTAMP '{AS_OF}' ELSE processed_at END AS processed_at,
       CASE WHEN error_text IS NULL THEN attempts ELSE 5 END AS attempts, substr(error_text, 1, 1000) AS error
FROM d""")
def stream_outbox_rows(t):
    """C19 by stream: the outbox rows once all are processed or out of attempts."""
    return SJ.outbox_final(t.spark, _outbox_sink(t))


def _outbox_sink(t):
    path = land(_conform(t.outbox, S.OUTBOX), "outbox", "outbox_id")
    return SJ.outbox_stream(t.spark, path, S.OUTBOX, t.users, AS_OF, files_per_trigger=files_a_batch(t.spark, path), retry_after_ms=200)


@query("stream_webhooks", _WEBHOOK + """
SELECT seq, event_id, disposition, target_payment_id FROM t""")
def stream_webhooks(t):
    """ST5: webhook requests streamed through ingest; event ids stay unique across micro-batches."""
    w = _conform(W.signed_inbound(t, HMAC_TEST_KEY), S.WEBHOOK_IN)
    path = land(w, "webhooks", "seq")
    return SJ.webhooks_stream(t.spark, path, t.payments, t.outbox, HMAC_TEST_KEY, files_per_trigger=files_a_batch(t.spark, path))


@query("stream_rate_limit", _limit_sql("1 day", 5))
def stream_rate_limit(t):
    """ST6: fixed-window limiter as a stateful stream (5 per day per client)."""
    w = _conform(t.webhook_inbound.withColumn("signature", F.lit(None).cast("string")), S.WEBHOOK_IN)
    path = land(w, "ratelimit", "seq")
    return SJ.rate_limit_stream(t.spark, path, "1 day", 5, keep="7 days", files_per_trigger=files_a_batch(t.spark, path)).drop("reason")
