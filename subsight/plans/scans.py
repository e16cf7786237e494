"""Scans of the base tables with explicit projections."""

from .registry import query

_COLS = {
    "plans": "plan_id, name, description, price, billing_cycle, duration_days, features, created_at, updated_at",
    "users": "user_id, first_name, last_name, email, phone, address, registration_date, role",
    "subscriptions": "subscription_id, user_id, plan_id, start_date, end_date, renewal_date, status, auto_renew",
    "payments": "payment_id, subscription_id, amount, payment_date, payment_method, transaction_id, status",
    "logs": "log_id, user_id, action, message, log_date",
}


def _register(table: str):
    cols = [c.strip() for c in _COLS[table].split(",")]

    @query(f"scan_{table}", f"SELECT {_COLS[table]} FROM {table}")
    def _scan(t):
        return getattr(t, table).select(*cols)

    _scan.__doc__ = f"Scan of {table} with its declared columns."


for _t in _COLS:
    _register(_t)
