"""Registered data-quality reports (Q1-Q8)."""

from ..operators import lookups as K
from ..operators import quality as Q
from .broken import CTES, Broken
from .registry import query


# The constraints once more, read off the schema for the SQL side.
_KEY = {"plans": "plan_id", "users": "user_id", "subscriptions": "subscription_id", "payments": "payment_id", "logs": "log_id",
        "outbox": "outbox_id", "webhook_events": "id"}
_TEXT = [("plans", "name"), ("plans", "billing_cycle"), ("users", "first_name"), ("users", "last_name"), ("users", "email"), ("users", "role"),
         ("subscriptions", "status"), ("payments", "transaction_id"), ("payments", "status"), ("logs", "action"),
         ("outbox", "type"), ("webhook_events", "event_id")]
_NOT_NULL = [("plans", "plan_id"), ("plans", "price"), ("plans", "duration_days"), ("plans", "created_at"),
             ("users", "user_id"), ("users", "registration_date"),
             ("subscriptions", "subscription_id"), ("subscriptions", "user_id"), ("subscriptions", "plan_id"), ("subscriptions", "start_date"),
             ("subscriptions", "end_date"), ("subscriptions", "auto_renew"),
             ("payments", "payment_id"), ("payments", "subscription_id"), ("payments", "amount"), ("payments", "payment_date"),
             ("logs", "log_id"), ("logs", "log_date"),
             ("outbox", "outbox_id"), ("outbox", "payload"), ("outbox", "created_at"), ("outbox", "attempts"),
             ("webhook_events", "id"), ("webhook_events", "raw_payload"), ("webhook_events", "received_at"), ("webhook_events", "processed")]
_LENGTH = [("plans", "name", 100), ("plans", "billing_cycle", 20), ("users", "first_name", 50), ("users", "last_name", 50), ("users", "email", 100),
           ("users", "phone", 15), ("users", "address", 200), ("users", "role", 20), ("payments", "payment_method", 50),
           ("payments", "transaction_id", 100), ("logs", "action", 100), ("outbox", "type", 100), ("outbox", "error", 1000),
           ("webhook_events", "event_id", 100), ("webhook_events", "signature", 200)]
_FROM = {"outbox": "outbox_messages", "webhook_events": "stored_events"}


def _sql(p: str = "") -> dict[str, str]:
    """Each family's SQL over the tables whose names start with ``p``."""

    def at(table):
        return p + table if p else _FROM.get(table, table)

    def v(table, rule, cond, value):
        return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST({_KEY[table]} AS VARCHAR) AS key, "
                f"CAST({value} AS VARCHAR) AS value FROM {at(table)} WHERE {cond}")

    def dup(table, rule, col, lower):
        k = f"lower({col})" if lower else col
        return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, {k} AS key, CAST(count(*) AS VARCHAR) AS value "
                f"FROM {at(table)} WHERE {col} IS NOT NULL GROUP BY {k} HAVING count(*) > 1")

    def orphan(table, rule, fk, parent):
        return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(c.{_KEY[table]} AS VARCHAR) AS key, "
                f"CAST(c.{fk} AS VARCHAR) AS value FROM {at(table)} c WHERE c.{fk} IS NOT NULL "
                f"AND NOT EXISTS (SELECT 1 FROM {at(parent)} p WHERE p.{fk} = c.{fk})")

    events = bool(p)  # the given tables hold requests; the stored events are a result of their own (webhook_events)
    here = [t for t in _KEY if t != "webhook_events" or events]
    both = " UNION ALL ".join
    return {
        "domain": both([v("plans", "price_non_negative", "price < 0", "price"), v("plans", "duration_positive", "duration_days <= 0", "duration_days"),
                        v("payments", "amount_non_negative", "amount < 0", "amount")]),
        "status": both([v("subscriptions", "status_enum", "NOT COALESCE(status IN ('Active','Cancelled','Expired'), false)", "status"),
                        v("payments", "status_enum", "NOT COALESCE(status IN ('Completed','Failed','Refunded'), false)", "status")]),
        "unique": both([dup("plans", "unique_name", "name", True), dup("users", "unique_email", "email", True),
                        dup("payments", "unique_transaction_id", "transaction_id", False)]
                       + [dup("webhook_events", "unique_event_id", "event_id", False)] * events),
        "foreign_keys": both([orphan("subscriptions", "fk_user", "user_id", "users"), orphan("subscriptions", "fk_plan", "plan_id", "plans"),
                              orphan("payments", "fk_subscription", "subscription_id", "subscriptions"), orphan("logs", "fk_user", "user_id", "users")]),
        "required": both([v(t, f"required_{c}", f"COALESCE(trim({c}), '') = ''", c) for t, c in _TEXT if t in here]
                         + [v(t, f"required_{c}", f"{c} IS NULL", c) for t, c in _NOT_NULL if t in here]
                         + [v(t, f"max_length_{c}", f"length({c}) > {n}", f"length({c})") for t, c, n in _LENGTH if t in here]),
        "ranges": both([v("plans", "price_range", "NOT (price BETWEEN 0 AND 999999)", "price"),
                        v("plans", "duration_range", "NOT (duration_days BETWEEN 1 AND 2000)", "duration_days"),
                        v("payments", "amount_range", "NOT (amount BETWEEN 0 AND 999999)", "amount")]),
        "email": both([v("users", "email_shape", "email IS NOT NULL AND NOT (length(email) - length(replace(email, '@', '')) = 1 "
                         "AND NOT starts_with(email, '@') AND NOT ends_with(email, '@'))", "email"),
                       v("users", "phone_shape", f"phone IS NOT NULL AND NOT regexp_matches(phone, '{Q.PHONE_PATTERN}')", "phone")]),
        "admin": ("SELECT 'subscriptions' AS table_name, 'admin_holds_subscription' AS rule, CAST(s.subscription_id AS VARCHAR) AS key, "
                  f"CAST(s.user_id AS VARCHAR) AS value FROM {at('subscriptions')} s "
                  f"WHERE EXISTS (SELECT 1 FROM {at('users')} u WHERE u.user_id = s.user_id AND lower(u.role) = 'admin')"),
    }


SQL, BAD = _sql(), _sql("b_")
DOMAIN, STATUS, UNIQUE, FKS = SQL["domain"], SQL["status"], SQL["unique"], SQL["foreign_keys"]
REQUIRED, RANGES, EMAIL, ADMIN = SQL["required"], SQL["ranges"], SQL["email"], SQL["admin"]


@query("dq_domain", DOMAIN)
def dq_domain(t):
    """Q1: price >= 0, duration > 0, amount >= 0."""
    return Q.domain(t.plans, t.payments)


@query("dq_status", STATUS)
def dq_status(t):
    """Q2: status enumerations."""
    return Q.statuses(t.subscriptions, t.payments)


@query("dq_unique", UNIQUE)
def dq_unique(t):
    """Q3: unique plan name, e-mail, transaction id."""
    return Q.uniqueness(t.plans, t.users, t.payments)


@query("dq_foreign_keys", FKS)
def dq_foreign_keys(t):
    """Q4: orphans of every foreign key."""
    return Q.foreign_keys(t.users, t.plans, t.subscriptions, t.payments, t.logs)


@query("dq_required", REQUIRED)
def dq_required(t):
    """Q5: required values and length limits."""
    return Q.required({"users": t.users, "plans": t.plans, "subscriptions": t.subscriptions,
                       "payments": t.payments, "logs": t.logs, "outbox": t.outbox})


@query("dq_ranges", RANGES)
def dq_ranges(t):
    """Q6: form ranges."""
    return Q.ranges(t.plans, t.payments)


@query("dq_email", EMAIL)
def dq_email(t):
    """Q7: e-mail and phone shape."""
    return Q.email_phone(t.users)


@query("dq_admin_subscriptions", ADMIN)
def dq_admin_subscriptions(t):
    """Q8: admins hold no subscriptions."""
    return Q.admin_subscriptions(t.users, t.subscriptions)


@query("quality_violations", " UNION ALL ".join([DOMAIN, STATUS, UNIQUE, FKS, REQUIRED, RANGES, EMAIL, ADMIN]))
def quality_violations(t):
    """Q1-Q8 in one report."""
    return Q.all_violations(t.users, t.plans, t.subscriptions, t.payments, t.logs, t.outbox)


@query("dq_domain_broken", BAD["domain"], CTES)
def dq_domain_broken(t):
    """Q1 over broken rows."""
    return dq_domain(Broken(t))


@query("dq_status_broken", BAD["status"], CTES)
def dq_status_broken(t):
    """Q2 over broken rows."""
    return dq_status(Broken(t))


@query("dq_unique_broken", BAD["unique"], CTES)
def dq_unique_broken(t):
    """Q3 over broken rows, stored webhook events included."""
    b = Broken(t)
    return Q.uniqueness(b.plans, b.users, b.payments, b.webhook_events)


@query("dq_foreign_keys_broken", BAD["foreign_keys"], CTES)
def dq_foreign_keys_broken(t):
    """Q4 over broken rows."""
    return dq_foreign_keys(Broken(t))


@query("dq_required_broken", BAD["required"], CTES)
def dq_required_broken(t):
    """Q5 over broken rows: every NOT NULL column and length limit of the seven tables."""
    b = Broken(t)
    return Q.required({n: getattr(b, n) for n in ("users", "plans", "subscriptions", "payments", "logs", "outbox", "webhook_events")})


@query("dq_ranges_broken", BAD["ranges"], CTES)
def dq_ranges_broken(t):
    """Q6 over broken rows."""
    return dq_ranges(Broken(t))


@query("dq_email_broken", BAD["email"], CTES)
def dq_email_broken(t):
    """Q7 over broken rows."""
    return dq_email(Broken(t))


@query("quality_violations_broken", " UNION ALL ".join(BAD.values()), CTES)
def quality_violations_broken(t):
    """Q1-Q8 in one report over broken rows."""
    b = Broken(t)
    return Q.all_violations(b.users, b.plans, b.subscriptions, b.payments, b.logs, b.outbox, b.webhook_events)


@query("deletable_plans_broken", """
SELECT plan_id, name FROM b_plans p WHERE NOT EXISTS (SELECT 1 FROM b_subscriptions s WHERE s.plan_id = p.plan_id)""", CTES)
def deletable_plans_broken(t):
    """J7 where some plans have no subscription."""
    b = Broken(t)
    return K.unreferenced(b.plans.select("plan_id", "name"), b.subscriptions, "plan_id")


@query("deletable_users_broken", """
SELECT user_id, email FROM b_users u WHERE NOT EXISTS (SELECT 1 FROM b_subscriptions s WHERE s.user_id = u.user_id)""", CTES)
def deletable_users_broken(t):
    """J7 where some users have no subscription."""
    b = Broken(t)
    return K.unreferenced(b.users.select("user_id", "email"), b.subscriptions, "user_id")


@query("duplicate_plan_names_broken", """
SELECT lower(name) AS key, COUNT(*) AS row_count, MIN(plan_id) AS min_id, MAX(plan_id) AS max_id
FROM b_plans GROUP BY lower(name) HAVING COUNT(*) > 1""", CTES)
def duplicate_plan_names_broken(t):
    """A8 where plan names repeat."""
    return K.duplicate_groups(Broken(t).plans, "name", "plan_id")


@query("duplicate_emails_broken", """
SELECT lower(email) AS key, COUNT(*) AS row_count, MIN(user_id) AS min_id, MAX(user_id) AS max_id
FROM b_users GROUP BY lower(email) HAVING COUNT(*) > 1""", CTES)
def duplicate_emails_broken(t):
    """A8 where e-mails repeat."""
    return K.duplicate_groups(Broken(t).users, "email", "user_id")
