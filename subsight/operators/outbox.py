"""Outbox dispatch (ST3, C19, F9, F10, P9) as a set-based job.

``dispatch`` takes every pending row at once (the reference polls 50 at a
time; the cap is a poll size, not a rule), routes by type and returns the
notifications, logs and the updated outbox rows. It is a pure function of
the snapshot, so replaying a batch gives the same result and a stream can
run it per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import money as M
from ..functions.dates import lit_ts
from ..functions.text import TEMPLATES, notification_log_text, render, s
from ..sources import schemas as S
from .changes import notification_rows

# Dispatcher routing and texts of the reference.
PROCESSED = "PaymentProcessed"
REFUNDED = "PaymentRefunded"
PROCESSED_SUBJECT = "Payment received"
REFUNDED_SUBJECT = "Payment refunded"
LOG_ACTION = "Outbox.PaymentProcessed"


def pending(outbox: DataFrame) -> DataFrame:
    """not processed and fewer than 5 attempts."""
    return outbox.where(F.col("processed_at").isNull() & (F.col("attempts") < S.MAX_OUTBOX_ATTEMPTS))


def dead_letter(outbox: DataFrame) -> DataFrame:
    """never processed and out of attempts - never fetched again."""
    return outbox.where(F.col("processed_at").isNull() & (F.col("attempts") >= S.MAX_OUTBOX_ATTEMPTS))


def next_batch(outbox: DataFrame, size: int = S.OUTBOX_BATCH) -> DataFrame:
    """The oldest ``size`` pending rows (outbox id breaks ties)."""
    return pending(outbox).orderBy("created_at", "outbox_id").limit(size)


def dispatch(outbox: DataFrame, users: DataFrame, as_of) -> dict[str, DataFrame]:
    """Route pending rows. A payment message whose payload is not JSON, whose
    members have the wrong kinds, or whose log row would name an unknown user, fails: attempts + 1 and the
    error text (cut to 1000 characters); nothing is sent for it. User id 0
    means no user. Returns {'results', 'outbox', 'notifications', 'logs'}."""
    p = pending(outbox)
    routed = F.col("type").isin(PROCESSED, REFUNDED)
    parsed = J.parse_payload(F.col("payload"))
    d = (p.withColumn("_json_ok", F.try_parse_json(F.col("payload")).isNotNull())
         .withColumn("_fits", J.payload_fits(F.col("payload")))
         .withColumn("pl", parsed)
         .withColumn("uid", F.when(F.col("pl.user_id") != 0, F.col("pl.user_id"))))
    known = users.select(F.col("user_id").alias("uid"), F.lit(True).alias("_known"))
    d = d.join(known, "uid", "left")
    error = (F.when(routed & ~F.col("_json_ok"), F.lit("Payload is not valid JSON."))
             .when(routed & ~F.col("_fits"), F.lit("Payload does not fit its message type."))
             .when((F.col("type") == PROCESSED) & F.col("uid").isNotNull() & F.col("_known").isNull(),
                   F.concat(F.lit("Log user "), s("uid"), F.lit(" does not exist."))))
    d = d.withColumn("error_text", F.substring(error, 1, S.ERROR_TEXT_LIMIT))
    ok = d.where(F.col("error_text").isNull())
    sent_processed = ok.where(F.col("type") == PROCESSED)
    sent_refunded = ok.where(F.col("type") == REFUNDED)
    notes = notification_rows(
        sent_processed, F.col("uid"), PROCESSED_SUBJECT,
        render(TEMPLATES["outbox_processed_body"], payment_id="pl.payment_id", subscription_id="pl.subscription_id",
               amount=M.currency_inr(F.col("pl.amount"))), as_of, keep=["outbox_id"]
    ).unionByName(notification_rows(
        sent_refunded, F.col("uid"), REFUNDED_SUBJECT,
        render(TEMPLATES["outbox_refunded_body"], payment_id="pl.payment_id", subscription_id="pl.subscription_id"),
        as_of, keep=["outbox_id"]))
    logs = sent_processed.select("outbox_id", F.col("uid").cast("bigint").alias("user_id"), F.lit(LOG_ACTION).alias("action"),
                                 render(TEMPLATES["outbox_delivered_log"], payment_id="pl.payment_id").alias("message"),
                                 lit_ts(as_of).alias("timestamp_utc"))
    failed = F.col("error_text").isNotNull()
    updated = d.select(
        "outbox_id", "type", "payload", "created_at",
        F.when(failed, F.col("processed_at")).otherwise(lit_ts(as_of)).alias("processed_at"),
        F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(failed, F.col("error_text")).alias("error"))
    results = d.select(
        "outbox_id", "type", F.when(failed, "failed").otherwise("processed").alias("result"),
        F.col("uid").alias("user_id"),
        F.when(~failed & (F.col("type") == PROCESSED), PROCESSED_SUBJECT)
         .when(~failed & (F.col("type") == REFUNDED), REFUNDED_SUBJECT).alias("subject"),
        F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"))
    return {"results": results, "outbox": updated, "notifications": notes, "logs": logs}


def notification_logs(notifications: DataFrame) -> DataFrame:
    """ST2: after delivery, a NotificationSent log row 'Type: Subject'."""
    return notifications.select("user_id", F.lit("NotificationSent").alias("action"),
                                notification_log_text(F.col("type"), F.col("subject")).alias("message"),
                                F.col("timestamp_utc"))
