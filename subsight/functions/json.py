"""JSON parse and serialise for webhook bodies and outbox payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import schemas as S


def outbox_payload(user_id: Column, subscription_id: Column, payment_id: Column, amount: Column,
                   type_: Column | None = None) -> Column:
    """{"Type"?, "UserId", "SubscriptionId", "PaymentId", "Amount"} as JSON text."""
    fields = []
    if type_ is not None:
        fields.append(type_.alias("Type"))
    fields += [user_id.alias("UserId"), subscription_id.alias("SubscriptionId"),
               payment_id.alias("PaymentId"), amount.cast(S.TOTAL).alias("Amount")]
    return F.to_json(F.struct(*fields))


def parse_payload(payload: Column) -> Column:
    """Outbox payload -> struct with missing members as 0."""
    p = F.from_json(payload, S.OUTBOX_PAYLOAD_DDL)
    return F.struct(
        F.coalesce(p["UserId"], F.lit(0)).alias("user_id"),
        F.coalesce(p["SubscriptionId"], F.lit(0)).alias("subscription_id"),
        F.coalesce(p["PaymentId"], F.lit(0)).alias("payment_id"),
        F.coalesce(p["Amount"], F.lit(0).cast(S.TOTAL)).alias("amount"))


def payload_fits(payload: Column) -> Column:
    """Whether an outbox payload is an object whose members, where present,
    have the kinds of the typed message: whole numbers, a number, a string."""
    v = F.try_parse_json(payload)

    def fits(path, pred):
        k = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return k.isNull() | pred(k)

    whole = [fits(f"$.{m}", lambda k: k == "BIGINT") for m in ("UserId", "SubscriptionId", "PaymentId")]
    return (F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & whole[0] & whole[1] & whole[2]
            & fits("$.Amount", lambda k: k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"))
            & fits("$.Type", lambda k: k.isin("STRING", "NULL", "VOID")))


def parse_webhook(raw: Column) -> Column:
    """Webhook body -> struct(valid, type, transaction_id, status, amount,
    user_id, subscription_id, payment_id).

    ``valid`` is false for text that is not a JSON object or has no string
    ``type``. Defaults: status Completed when absent or null, amount 0,
    ids NULL. Members of the wrong JSON kind make the body invalid, as the
    typed reads of the reference throw on them."""
    v = F.try_parse_json(raw)

    def kind(path):
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def absent_or(path, pred):
        k = kind(path)
        return k.isNull() | k.isin("NULL", "VOID") | pred(k)

    def is_string(k):
        return k == "STRING"

    def is_number(k):
        return k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")

    def number_or_absent(path):
        # a typed read of a null number fails
        k = kind(path)
        return k.isNull() | is_number(k)

    def int_member(path):
        # whole numbers in range, else NULL (never an error)
        return F.when(kind(path) == "BIGINT", F.try_variant_get(v, path, "bigint"))

    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    has_type = F.coalesce(kind("$.type").isin("STRING", "NULL", "VOID"), F.lit(False))
    valid = (is_obj & has_type & absent_or("$.status", is_string) & absent_or("$.transactionId", is_string)
             & number_or_absent("$.amount") & number_or_absent("$.userId")
             & number_or_absent("$.subscriptionId") & number_or_absent("$.paymentId"))
    return F.struct(
        valid.alias("valid"),
        F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("")).alias("type"),
        F.try_variant_get(v, "$.transactionId", "string").alias("transaction_id"),
        F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("Completed")).alias("status"),
        F.coalesce(F.try_variant_get(v, "$.amount", "decimal(18,2)"), F.lit(0).cast(S.TOTAL)).alias("amount"),
        int_member("$.userId").alias("user_id"),
        int_member("$.subscriptionId").alias("subscription_id"),
        int_member("$.paymentId").alias("payment_id"))
