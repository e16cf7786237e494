"""Payment webhook ingest (ST5, C15, S9): signature, event-id dedup,
parse, payment status update, outbox row - as one set-based job.

Disposition per inbound request, in the reference's order:
missing_event_id -> unauthorized -> duplicate (first event id wins, by
arrival) -> malformed -> accepted. A body with an unknown status would
violate the payments CHECK and fail the request: ``invalid_status``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hmac as H
from ..functions import json as J
from ..functions.predicates import blank_col
from ..sources import schemas as S
from . import ids
from .changes import _rewritten

FORGED = "forged-signature"

# Webhook body type that marks a refund, and the outbox types.
REFUND_EVENT_TYPE = "payment.refunded"
OUTBOX_REFUNDED = "PaymentRefunded"
OUTBOX_PROCESSED = "PaymentProcessed"


def signed_inbound(t, secret: str) -> DataFrame:
    """Test landing rows: bodies signed with ``secret``; every 13th request
    carries a wrong signature and every 17th arrives without an event id."""
    w = t.webhook_inbound
    return w.select(
        "seq", "received_at", "client_key",
        F.when(F.col("seq") % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("event_id")).alias("event_id"),
        F.when(F.col("seq") % 13 == 0, F.lit(FORGED)).otherwise(H.hmac_sha256_base64(F.col("raw_payload"), secret)).alias("signature"),
        "raw_payload")


def dispositions(inbound: DataFrame, secret: str, known_event_ids: DataFrame | None = None,
                 new_event_ids: DataFrame | None = None) -> DataFrame:
    """Adds ``disposition`` and the parsed body ``b``.

    The first request of each event id (smallest seq among the
    authenticated) wins; it is found with a min aggregate and joined back on
    seq, so a hot event id costs one partial aggregate, not one large group.
    ``known_event_ids`` (the WebhookEvents sink) makes the id permanent
    across batches; a stream passes ``new_event_ids``, the ids its state has
    not seen before."""
    w = inbound.withColumn("_sig_ok", H.signature_ok(F.col("raw_payload"), F.col("signature"), secret))
    candidates = w.where(~blank_col(F.col("event_id")) & F.col("_sig_ok"))
    if known_event_ids is not None:
        candidates = candidates.join(known_event_ids.select("event_id"), "event_id", "left_anti")
    if new_event_ids is not None:
        candidates = candidates.join(new_event_ids.select("event_id"), "event_id", "left_semi")
    winners = candidates.groupBy("event_id").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("_first"))
    w = w.join(winners, "seq", "left").withColumn("b", J.parse_webhook(F.col("raw_payload")))
    disp = (F.when(blank_col(F.col("event_id")), "missing_event_id")
            .when(~F.col("_sig_ok"), "unauthorized")
            .when(F.col("_first").isNull(), "duplicate")
            .when(~F.col("b.valid"), "malformed")
            .when(~F.col("b.status").isin(*S.PAYMENT_STATUSES), "invalid_status")
            .otherwise("accepted"))
    return w.withColumn("disposition", disp).drop("_sig_ok", "_first")


def outbox_type(body_type) -> F.Column:
    return F.when(body_type == REFUND_EVENT_TYPE, OUTBOX_REFUNDED).otherwise(OUTBOX_PROCESSED)


def ingest(inbound: DataFrame, payments: DataFrame, outbox: DataFrame, secret: str,
           known_event_ids: DataFrame | None = None, with_outbox: bool = True,
           new_event_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Returns {'events', 'payment_updates', 'outbox', 'dispositions'}.

    Outbox ids continue the outbox table in arrival order; assigning them
    writes the accepted rows to the checkpoint folder, so callers that need
    no outbox rows pass ``with_outbox=False``.

    Payment update (C15): by transaction id when the body has one, else by
    payment id; when several accepted events hit one payment, the last by
    arrival wins."""
    # Every output reads the dispositions; write them once to the shared
    # folder instead of re-verifying and re-parsing per output.
    d = _rewritten(dispositions(inbound, secret, known_event_ids, new_event_ids), "dispositions")
    acc = d.where(F.col("disposition") == "accepted")
    # stored events: every authenticated first arrival (malformed ones stay unprocessed)
    events = d.where(F.col("disposition").isin("accepted", "malformed", "invalid_status")).select(
        F.col("seq").cast("bigint").alias("id"), "event_id", "signature", "raw_payload", "received_at",
        (F.col("disposition") == "accepted").alias("processed"))
    # An accepted request is looked up by its transaction id when it has one,
    # else by its payment id. Payments meet the requests once for each of the
    # two that occurs, with no other column: payment ids alone are a fraction
    # of what all payments under both keys would be in a shuffle.
    use_txn = ~blank_col(F.col("b.transaction_id"))
    lookups = {"transaction_id": acc.where(use_txn), "payment_id": acc.where(~use_txn & F.col("b.payment_id").isNotNull())}
    found = [payments.select("payment_id", F.col(key).alias("_k"))
             .join(some.select("seq", F.col(f"b.{key}").alias("_k")), "_k").select("seq", F.col("payment_id").alias("target_payment_id"))
             for key, some in lookups.items() if not some.isEmpty()]
    none = acc.select("seq", F.lit(None).cast("bigint").alias("target_payment_id")).limit(0)
    matches = reduce(DataFrame.unionByName, found) if found else none
    a = acc.join(matches, "seq", "left")
    # accepted statuses are one of the enumeration: carry their position (an
    # int) through max_by so the aggregate stays a hash aggregate
    statuses = F.array(*[F.lit(x) for x in S.PAYMENT_STATUSES])
    last = (a.where(F.col("target_payment_id").isNotNull())
            .withColumn("_code", F.array_position(statuses, F.col("b.status")).cast("int"))
            .groupBy("target_payment_id")
            .agg(F.max_by("_code", "seq").alias("_code"), F.max("seq").alias("seq")))
    updates = last.select(F.col("target_payment_id").alias("payment_id"),
                          F.element_at(statuses, F.col("_code")).alias("status"), "seq")
    result = {"events": events, "payment_updates": updates,
              "dispositions": a.select("seq", "event_id", "disposition", "target_payment_id")
              .unionByName(d.where(F.col("disposition") != "accepted")
                           .select("seq", "event_id", "disposition", F.lit(None).cast("bigint").alias("target_payment_id")))}
    if not with_outbox:
        return result
    box = ids.assign_ids(acc, ["seq"], ids.max_id(outbox, "outbox_id"), "outbox_id", cast="bigint")
    box = box.select(
        "outbox_id", outbox_type(F.col("b.type")).alias("type"),
        J.outbox_payload(F.coalesce("b.user_id", F.lit(0)), F.coalesce("b.subscription_id", F.lit(0)),
                         F.coalesce("b.payment_id", F.lit(0)), F.col("b.amount"), type_=F.col("b.type")).alias("payload"),
        F.col("received_at").alias("created_at"), F.lit(None).cast(S.TS).alias("processed_at"),
        F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    result["outbox"] = box
    return result
