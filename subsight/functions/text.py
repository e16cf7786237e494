"""Text expressions: log and notification texts, CSV fields, date text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's log and notification texts ({name} marks a
# value filled in per row). The cancel text holds a non-breaking hyphen
# (U+2011) in "Pro-rata", as in the reference.
TEMPLATES = {
    "subscribed_log": "User {user_id} subscribed to Plan {plan_name} (PlanId={plan_id}), SubId={subscription_id}.",
    "subscribed_payment_log": "Payment {payment_id} completed for subscription {subscription_id} amount {amount}.",
    "subscribed_body": "Your subscription (ID {subscription_id}) to {plan_name} is active.",
    "renewed_log": "Subscription {subscription_id} renewed to {new_end}. Plan {plan_name}.",
    "renewed_body": "Your subscription (ID {subscription_id}) has been renewed through {new_end}.",
    "cancelled_log": "Subscription {subscription_id} cancelled. Pro‑rata refund: {refund} for plan {plan_name}.",
    "cancelled_body": "Your subscription (ID {subscription_id}) was cancelled. Refund amount: {refund}.",
    "expired_log": "Subscription {subscription_id} expired.",
    "expired_body": "Your subscription (ID {subscription_id}) has expired.",
    "expiry_run_log": "Expired {count} subscription(s) at {stamp}",
    "payment_recorded_log": "Payment {payment_id} recorded for subscription {subscription_id} amount {amount}.",
    "payment_refunded_log": "Payment {payment_id} refunded for subscription {subscription_id}. Estimated refund: {estimate}. Plan {plan_name}.",
    "plan_created_log": "Plan '{name}' (Id={plan_id}) created.",
    "plan_updated_log": "Plan '{name}' (Id={plan_id}) updated.",
    "plan_deleted_log": "Plan (Id={plan_id}) deleted.",
    "user_registered_log": "User {email} registered.",
    "user_updated_log": "User {email} updated.",
    "user_deleted_log": "User (Id={user_id}) deleted by Admin (Id={actor_user_id}).",
    "outbox_processed_body": "Payment {payment_id} for subscription {subscription_id} amount {amount} processed.",
    "outbox_refunded_body": "Payment {payment_id} for subscription {subscription_id} has been refunded.",
    "outbox_delivered_log": "Outbox delivered payment {payment_id}",
    "notification_sent_log": "{type}: {subject}",
    "seed_log": "Seed log entry #{log_id} at {log_date}",
}

_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, **values) -> Column:
    """A template as one column: literal pieces and the given columns
    (cast to text) concatenated, e.g. render(TEMPLATES["expired_log"],
    subscription_id=F.col("subscription_id"))."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = values[m.group(1)]
        parts.append((v if isinstance(v, Column) else F.col(v)).cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def date_text(ts: Column) -> Column:
    """yyyy-MM-dd."""
    return F.date_format(ts, "yyyy-MM-dd")


def datetime_text(ts: Column) -> Column:
    """CONVERT(VARCHAR(19), ts, 120): yyyy-MM-dd HH:mm:ss."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def csv_quoted(c: Column) -> Column:
    """Field in double quotes with quotes doubled."""
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def notification_log_text(type_: Column, subject: Column) -> Column:
    """Log message written after a notification is sent: 'Type: Subject'."""
    return render(TEMPLATES["notification_sent_log"], type=type_, subject=subject)
