"""DuckDB side of the correctness check.

The oracle sees only the driver's raw tables, so every oracle statement is
prefixed with the same table mapping as ``sources.tables``, written in
DuckDB SQL. ``oracle(sql)`` adds the mapping CTEs the statement needs."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2001-08-15 00:00:00'"

MAPPING = {
    "plans": """
SELECT CAST(p_partkey AS BIGINT) AS plan_id,
       concat(p_name, ' #', CAST(p_partkey AS VARCHAR)) AS name,
       concat(p_type, ' by ', p_brand) AS description,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price,
       CASE WHEN p_size % 2 = 0 THEN 'Monthly' ELSE 'Yearly' END AS billing_cycle,
       CASE WHEN p_size % 2 = 0 THEN 30 ELSE 365 END AS duration_days,
       concat('{"users":', CAST(p_size AS VARCHAR), ',"support":"', lower(p_type), '"}') AS features,
       TIMESTAMP '1995-01-01 00:00:00' + CAST(p_partkey % 365 AS INTEGER) * INTERVAL '1' DAY AS created_at,
       CAST(NULL AS TIMESTAMP) AS updated_at
FROM part""",
    "users": """
SELECT CAST(c_custkey AS BIGINT) AS user_id, c_mktsegment AS first_name, c_name AS last_name,
       concat(lower(replace(c_name, '#', '.')), '@example.com') AS email,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('555', lpad(CAST(c_custkey AS VARCHAR), greatest(7, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0')) END AS phone,
       CAST(NULL AS VARCHAR) AS address,
       TIMESTAMP '1995-01-01 00:00:00' + CAST(c_custkey % 365 AS INTEGER) * INTERVAL '1' DAY AS registration_date,
       CASE WHEN c_custkey % 10 = 0 THEN 'Admin' ELSE 'Subscriber' END AS role
FROM customer""",
    "subscriptions": """
SELECT CAST(o.o_orderkey AS BIGINT) AS subscription_id, CAST(o.o_custkey AS BIGINT) AS user_id,
       CAST(p.p_partkey AS BIGINT) AS plan_id, o.o_orderdate AS start_date,
       o.o_orderdate + CAST(CASE WHEN p.p_size % 2 = 0 THEN 30 ELSE 365 END AS INTEGER) * INTERVAL '1' DAY AS end_date,
       CAST(NULL AS TIMESTAMP) AS renewal_date,
       CASE o.o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Expired' ELSE 'Cancelled' END AS status,
       o.o_orderkey % 2 = 0 AS auto_renew
FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)""",
    "payments": """
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS payment_id, CAST(l_orderkey AS BIGINT) AS subscription_id,
       CAST(min(l_extendedprice) AS DECIMAL(10,2)) AS amount, min(l_shipdate) AS payment_date,
       CASE WHEN l_linenumber % 3 = 0 THEN 'PayPal' ELSE 'Credit Card' END AS payment_method,
       concat('TXN-', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)) AS transaction_id,
       CASE min(l_returnflag) WHEN 'N' THEN 'Completed' WHEN 'R' THEN 'Refunded' ELSE 'Failed' END AS status
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "logs": """
SELECT CAST(event_id AS BIGINT) AS log_id,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS user_id,
       CASE event_type WHEN 'signup' THEN 'UserRegistered' WHEN 'view' THEN 'UserLogin' WHEN 'click' THEN 'SubscriptionRenewed'
            WHEN 'purchase' THEN 'PaymentProcessed' ELSE 'Exception' END AS action,
       concat('Seed log entry #', CAST(event_id AS VARCHAR)) AS message, ts AS log_date
FROM events""",
    "outbox_messages": """
SELECT event_id AS outbox_id,
       CASE event_type WHEN 'purchase' THEN 'PaymentProcessed' WHEN 'error' THEN 'PaymentRefunded' ELSE 'Notification.Email' END AS type,
       concat('{"UserId":', CAST(user_id AS VARCHAR), ',"SubscriptionId":', CAST(event_id % (SELECT count(*) FROM orders) AS VARCHAR),
              ',"PaymentId":', CAST((event_id % (SELECT count(*) FROM orders)) * 10 + 1 AS VARCHAR), ',"Amount":', CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR), '}') AS payload,
       ts AS created_at,
       CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '1' HOUR ELSE NULL END AS processed_at,
       CAST(event_id % 7 AS INTEGER) AS attempts,
       CAST(NULL AS VARCHAR) AS error
FROM events""",
    "webhook_inbound": """
SELECT concat('evt-', CAST(CAST(floor(event_id / 2) AS BIGINT) AS VARCHAR)) AS event_id, event_id AS seq, ts AS received_at,
       concat('client-', CAST(user_id AS VARCHAR)) AS client_key,
       CASE WHEN event_id % 11 = 0 THEN '{bad'
            ELSE concat('{"type":"', CASE WHEN event_type = 'error' THEN 'payment.refunded' ELSE 'payment.succeeded' END,
                 '","transactionId":"TXN-', CAST((event_id % (SELECT count(*) FROM orders)) * 10 + 1 AS VARCHAR),
                 '","status":"', CASE WHEN event_type = 'error' THEN 'Refunded' ELSE 'Completed' END,
                 '","amount":', CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR), ',"userId":', CAST(user_id AS VARCHAR), '}') END AS raw_payload
FROM events WHERE event_type IN ('purchase', 'error')""",
}

_ORDER = list(MAPPING)


def _uses(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def oracle(sql: str, extra_ctes: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the mapping CTEs (and extra named CTEs) it uses.

    ``extra_ctes`` are command inputs etc. written over the mapped tables;
    they may reference each other in insertion order."""
    ctes: list[tuple[str, str]] = []
    extra = dict(extra_ctes or {})
    body = sql + " ".join(extra.values())
    for name in _ORDER:
        if _uses(body, name):
            ctes.append((name, MAPPING[name]))
    ctes.extend(extra.items())
    if not ctes:
        return sql.strip()
    # materialised: a table that a statement meets twice is mapped once
    head = ",\n".join(f"{n} AS MATERIALIZED ({q.strip()})" for n, q in ctes)
    body = sql.strip()
    if re.match(r"(?i)with\s", body):  # merge with the statement's own CTEs
        return f"WITH {head},\n{body[4:].lstrip()}"
    return f"WITH {head}\n{body}"
