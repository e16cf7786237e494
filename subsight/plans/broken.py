"""The tables with some rows broken by a rule on their keys, so that every
quality report has something to find. One SQL text per column serves both
engines: it makes the input, not the result."""

from pyspark.sql import functions as F

from ..operators import webhooks as W
from .events import _WEBHOOK
from .registry import HMAC_TEST_KEY

COLUMNS = {
    "plans": {
        "name": "CASE WHEN plan_id % 47 = 1 THEN ' ' WHEN plan_id % 53 = 4 THEN 'Same Name' WHEN plan_id % 53 = 5 THEN 'SAME name' "
                "WHEN plan_id % 59 = 6 THEN repeat('n', 101) WHEN plan_id % 61 = 7 THEN NULL ELSE name END",
        "price": "CASE WHEN plan_id % 41 = 3 THEN -price WHEN plan_id % 83 = 9 THEN NULL WHEN plan_id % 71 = 2 THEN 1000000.00 ELSE price END",
        "billing_cycle": "CASE WHEN plan_id % 67 = 8 THEN repeat('m', 21) WHEN plan_id % 73 = 1 THEN NULL ELSE billing_cycle END",
        "duration_days": "CASE WHEN plan_id % 43 = 5 THEN 0 WHEN plan_id % 89 = 2 THEN 4000 WHEN plan_id % 79 = 3 THEN NULL ELSE duration_days END",
        "created_at": "CASE WHEN plan_id % 97 = 8 THEN NULL ELSE created_at END"},
    "users": {
        "first_name": "CASE WHEN user_id % 41 = 1 THEN '' WHEN user_id % 43 = 2 THEN repeat('f', 51) ELSE first_name END",
        "last_name": "CASE WHEN user_id % 47 = 3 THEN NULL ELSE last_name END",
        "email": "CASE WHEN user_id % 31 = 4 THEN 'Same@example.com' WHEN user_id % 31 = 5 THEN 'same@EXAMPLE.com' WHEN user_id % 37 = 6 THEN '@bad' "
                 "WHEN user_id % 59 = 7 THEN 'two@@x.org' WHEN user_id % 61 = 8 THEN NULL ELSE email END",
        "phone": "CASE WHEN user_id % 53 = 9 THEN 'phone!' WHEN user_id % 67 = 1 THEN '55555555555555555555' ELSE phone END",
        "registration_date": "CASE WHEN user_id % 71 = 2 THEN NULL ELSE registration_date END",
        "role": "CASE WHEN user_id % 73 = 3 THEN NULL ELSE role END"},
    "subscriptions": {
        "user_id": "CASE WHEN user_id % 10 = 7 THEN user_id - 1 WHEN subscription_id % 103 = 2 THEN -1 WHEN subscription_id % 107 = 3 THEN NULL ELSE user_id END",
        "plan_id": "CASE WHEN plan_id % 10 = 3 THEN plan_id - 1 WHEN subscription_id % 101 = 4 THEN -1 WHEN subscription_id % 109 = 5 THEN NULL ELSE plan_id END",
        "start_date": "CASE WHEN subscription_id % 113 = 6 THEN NULL ELSE start_date END",
        "end_date": "CASE WHEN subscription_id % 127 = 7 THEN NULL ELSE end_date END",
        "status": "CASE WHEN subscription_id % 97 = 8 THEN 'Paused' WHEN subscription_id % 131 = 9 THEN NULL ELSE status END",
        "auto_renew": "CASE WHEN subscription_id % 137 = 1 THEN NULL ELSE auto_renew END"},
    "payments": {
        "subscription_id": "CASE WHEN payment_id % 211 = 1 THEN -1 WHEN payment_id % 223 = 2 THEN NULL ELSE subscription_id END",
        "amount": "CASE WHEN payment_id % 227 = 3 THEN -amount WHEN payment_id % 229 = 4 THEN NULL ELSE amount END",
        "payment_date": "CASE WHEN payment_id % 233 = 5 THEN NULL ELSE payment_date END",
        "payment_method": "CASE WHEN payment_id % 239 = 6 THEN repeat('c', 51) ELSE payment_method END",
        "transaction_id": "CASE WHEN payment_id % 241 = 7 THEN 'TXN-same' WHEN payment_id % 251 = 8 THEN NULL ELSE transaction_id END",
        "status": "CASE WHEN payment_id % 257 = 9 THEN 'Pending' WHEN payment_id % 263 = 1 THEN NULL ELSE status END"},
    "logs": {
        "user_id": "CASE WHEN log_id % 101 = 1 THEN -1 ELSE user_id END",
        "action": "CASE WHEN log_id % 103 = 2 THEN ' ' WHEN log_id % 107 = 3 THEN repeat('a', 101) ELSE action END",
        "log_date": "CASE WHEN log_id % 109 = 4 THEN NULL ELSE log_date END"},
    "outbox": {
        "type": "CASE WHEN outbox_id % 101 = 1 THEN NULL ELSE type END",
        "payload": "CASE WHEN outbox_id % 103 = 2 THEN NULL ELSE payload END",
        "created_at": "CASE WHEN outbox_id % 107 = 3 THEN NULL ELSE created_at END",
        "attempts": "CASE WHEN outbox_id % 109 = 4 THEN NULL ELSE attempts END",
        "error": "CASE WHEN outbox_id % 113 = 5 THEN repeat('e', 1001) ELSE error END"},
    "webhook_events": {
        "event_id": "CASE WHEN id % 29 = 1 THEN 'evt-same' WHEN id % 31 = 2 THEN ' ' ELSE event_id END",
        "signature": "CASE WHEN id % 37 = 3 THEN repeat('s', 201) ELSE 'given' END",
        "raw_payload": "CASE WHEN id % 41 = 4 THEN NULL ELSE raw_payload END",
        "received_at": "CASE WHEN id % 43 = 5 THEN NULL ELSE received_at END",
        "processed": "CASE WHEN id % 47 = 6 THEN NULL ELSE processed END"},
}
ALL = {
    "plans": "plan_id, name, description, price, billing_cycle, duration_days, features, created_at, updated_at",
    "users": "user_id, first_name, last_name, email, phone, address, registration_date, role",
    "subscriptions": "subscription_id, user_id, plan_id, start_date, end_date, renewal_date, status, auto_renew",
    "payments": "payment_id, subscription_id, amount, payment_date, payment_method, transaction_id, status",
    "logs": "log_id, user_id, action, message, log_date",
    "outbox": "outbox_id, type, payload, created_at, processed_at, attempts, error",
    "webhook_events": "id, event_id, signature, raw_payload, received_at, processed",
}
_SOURCE = {"outbox": "outbox_messages", "webhook_events": "stored_events"}


def _list(table: str) -> list[str]:
    return [f"{COLUMNS[table][c]} AS {c}" if c in COLUMNS[table] else c for c in ALL[table].split(", ")]


EVENTS_SQL = _WEBHOOK + """
SELECT CAST(seq AS BIGINT) AS id, event_id, '' AS signature, raw_payload, received_at, disposition = 'accepted' AS processed
FROM t WHERE disposition IN ('accepted', 'malformed', 'invalid_status')"""
# the broken tables for DuckDB, named b_<table>
CTES = {"stored_events": EVENTS_SQL} | {f"b_{t}": f"SELECT {', '.join(_list(t))} FROM {_SOURCE.get(t, t)}" for t in ALL}


class Broken:
    """The same tables for Spark."""

    def __init__(self, t):
        self.t = t

    def __getattr__(self, name: str):
        if name == "webhook_events":
            df = W.ingest(W.signed_inbound(self.t, HMAC_TEST_KEY), self.t.payments, self.t.outbox, HMAC_TEST_KEY, with_outbox=False)["events"]
        else:
            df = getattr(self.t, name)
        return df.select(*[F.expr(x) for x in _list(name)])
