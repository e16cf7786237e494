"""Data-quality checks (Q1-Q8): the schema's CHECK / UNIQUE / FK
constraints and the form validators as violation reports.

Every rule is a filter (or an anti join / grouped count) producing rows of
(table_name, rule, key, value); the full report is their union, one scan
per table and rule family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import blank_col
from ..sources import schemas as S

# Length limits of the reference schema and forms.
LENGTH_LIMITS = {
    "plans": {"name": 100, "billing_cycle": 20},
    "users": {"first_name": 50, "last_name": 50, "email": 100, "phone": 15, "address": 200, "role": 20},
    "payments": {"payment_method": 50, "transaction_id": 100},
    "logs": {"action": 100},
    "outbox": {"type": 100, "error": 1000},
    "webhook_events": {"event_id": 100, "signature": 200},
}
# required text: neither NULL nor blank
REQUIRED = {
    "plans": ["name", "billing_cycle"],
    "users": ["first_name", "last_name", "email", "role"],
    "payments": ["transaction_id", "status"],
    "subscriptions": ["status"],
    "logs": ["action"],
    "outbox": ["type"],
    "webhook_events": ["event_id"],
}
# other columns that the schema declares NOT NULL
NOT_NULL = {
    "plans": ["plan_id", "price", "duration_days", "created_at"],
    "users": ["user_id", "registration_date"],
    "subscriptions": ["subscription_id", "user_id", "plan_id", "start_date", "end_date", "auto_renew"],
    "payments": ["payment_id", "subscription_id", "amount", "payment_date"],
    "logs": ["log_id", "log_date"],
    "outbox": ["outbox_id", "payload", "created_at", "attempts"],
    "webhook_events": ["id", "raw_payload", "received_at", "processed"],
}
KEYS = {"plans": "plan_id", "users": "user_id", "subscriptions": "subscription_id",
        "payments": "payment_id", "logs": "log_id", "outbox": "outbox_id", "webhook_events": "id"}
# Phone rule of the form validator: after '+' and an extension are removed,
# at least one digit and only digits, blanks and - . ( ).
PHONE_PATTERN = r"^[0-9\s\-.()+]*[0-9][0-9\s\-.()+]*(\s*(x|ext\.?)\s*[0-9]+)?$"


def _v(df: DataFrame, table: str, rule: str, cond: Column, value: Column) -> DataFrame:
    return _row_rules(df, table, [(rule, cond, value)])


def _row_rules(df: DataFrame, table: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """All row-level rules of one table in one scan: each row yields an
    array of the rules it breaks, exploded into report rows."""
    key = KEYS[table]
    hits = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)),
                                     F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value")))
                              for rule, cond, value in rules]), lambda x: x.isNotNull())
    return (df.select(F.col(key).cast("string").alias("key"), F.explode(hits).alias("h"))
            .select(F.lit(table).alias("table_name"), F.col("h.rule").alias("rule"), "key", F.col("h.value").alias("value")))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def domain_rules():
    return {"plans": [("price_non_negative", F.col("price") < 0, F.col("price")),
                      ("duration_positive", F.col("duration_days") <= 0, F.col("duration_days"))],
            "payments": [("amount_non_negative", F.col("amount") < 0, F.col("amount"))]}


def status_rules():
    return {"subscriptions": [("status_enum", ~F.coalesce(F.col("status").isin(*S.SUBSCRIPTION_STATUSES), F.lit(False)),
                               F.col("status"))],
            "payments": [("status_enum", ~F.coalesce(F.col("status").isin(*S.PAYMENT_STATUSES), F.lit(False)),
                          F.col("status"))]}


def required_rules():
    out: dict[str, list] = {}
    for t, cols in REQUIRED.items():
        out.setdefault(t, []).extend((f"required_{c}", blank_col(F.col(c)), F.col(c)) for c in cols)
    for t, cols in NOT_NULL.items():
        out.setdefault(t, []).extend((f"required_{c}", F.col(c).isNull(), F.col(c)) for c in cols)
    for t, limits in LENGTH_LIMITS.items():
        out.setdefault(t, []).extend((f"max_length_{c}", F.length(F.col(c)) > n, F.length(F.col(c)))
                                     for c, n in limits.items())
    return out


def range_rules():
    return {"plans": [("price_range", ~F.col("price").between(0, 999999), F.col("price")),
                      ("duration_range", ~F.col("duration_days").between(1, 2000), F.col("duration_days"))],
            "payments": [("amount_range", ~F.col("amount").between(0, 999999), F.col("amount"))]}


def contact_rules():
    at_count = F.length(F.col("email")) - F.length(F.replace(F.col("email"), F.lit("@"), F.lit("")))
    bad_email = ~((at_count == 1) & ~F.col("email").startswith("@") & ~F.col("email").endswith("@"))
    bad_phone = F.col("phone").isNotNull() & ~F.col("phone").rlike(PHONE_PATTERN)
    return {"users": [("email_shape", F.col("email").isNotNull() & bad_email, F.col("email")),
                      ("phone_shape", bad_phone, F.col("phone"))]}


def _family(tables: dict[str, DataFrame], rules: dict[str, list]) -> DataFrame:
    return _union([_row_rules(tables[t], t, r) for t, r in rules.items() if t in tables])


def domain(plans: DataFrame, payments: DataFrame) -> DataFrame:
    return _family({"plans": plans, "payments": payments}, domain_rules())


def statuses(subscriptions: DataFrame, payments: DataFrame) -> DataFrame:
    return _family({"subscriptions": subscriptions, "payments": payments}, status_rules())


def _dups(df: DataFrame, table: str, rule: str, col: str, lower: bool) -> DataFrame:
    k = F.lower(F.col(col)) if lower else F.col(col)
    g = df.where(F.col(col).isNotNull()).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return g.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col("k").alias("key"),
                    F.col("n").cast("string").alias("value"))


def uniqueness(plans: DataFrame, users: DataFrame, payments: DataFrame, webhook_events: DataFrame | None = None) -> DataFrame:
    events = [] if webhook_events is None else [_dups(webhook_events, "webhook_events", "unique_event_id", "event_id", False)]
    return _union(events + [
        _dups(plans, "plans", "unique_name", "name", True),
        _dups(users, "users", "unique_email", "email", True),
        _dups(payments, "payments", "unique_transaction_id", "transaction_id", False),
    ])


def _orphans(child: DataFrame, table: str, rule: str, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    c = child.where(F.col(fk).isNotNull())
    o = c.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    return _v(o, table, rule, F.lit(True), F.col(fk))


def foreign_keys(users, plans, subscriptions, payments, logs) -> DataFrame:
    return _union([
        _orphans(subscriptions, "subscriptions", "fk_user", "user_id", users, "user_id"),
        _orphans(subscriptions, "subscriptions", "fk_plan", "plan_id", plans, "plan_id"),
        _orphans(payments, "payments", "fk_subscription", "subscription_id", subscriptions, "subscription_id"),
        _orphans(logs, "logs", "fk_user", "user_id", users, "user_id"),
    ])


def required(tables: dict[str, DataFrame]) -> DataFrame:
    return _family(tables, required_rules())


def ranges(plans: DataFrame, payments: DataFrame) -> DataFrame:
    return _family({"plans": plans, "payments": payments}, range_rules())


def email_phone(users: DataFrame) -> DataFrame:
    return _family({"users": users}, contact_rules())


def admin_subscriptions(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    admins = users.where(F.lower("role") == "admin").select("user_id")
    s = subscriptions.join(admins, "user_id", "left_semi")
    return _v(s, "subscriptions", "admin_holds_subscription", F.lit(True), F.col("user_id"))


def all_violations(users, plans, subscriptions, payments, logs, outbox=None, webhook_events=None) -> DataFrame:
    """Every rule in as few passes as possible: each child table is read
    once, left-joined with the keys (and roles) of its parents, and all its
    row rules and foreign-key rules are evaluated on that one frame; plans
    and users get one pass each for their row rules; uniqueness is one
    grouped count per key."""
    merged: dict[str, list] = {}
    for fam in (domain_rules(), status_rules(), required_rules(), range_rules(), contact_rules()):
        for t, r in fam.items():
            merged.setdefault(t, []).extend(r)

    def known(df, key, alias, extra=()):
        return df.select(F.col(key).alias(alias), *extra, F.lit(True).alias(f"{alias}_known"))

    subs = (subscriptions
            .join(known(users, "user_id", "_u", [F.col("role").alias("_role")]), F.col("user_id") == F.col("_u"), "left")
            .join(known(plans, "plan_id", "_p"), F.col("plan_id") == F.col("_p"), "left"))
    sub_rules = merged.get("subscriptions", []) + [
        ("fk_user", F.col("user_id").isNotNull() & F.col("_u_known").isNull(), F.col("user_id")),
        ("fk_plan", F.col("plan_id").isNotNull() & F.col("_p_known").isNull(), F.col("plan_id")),
        ("admin_holds_subscription", F.lower(F.col("_role")) == "admin", F.col("user_id"))]
    pays = payments.join(known(subscriptions, "subscription_id", "_s"), F.col("subscription_id") == F.col("_s"), "left")
    pay_rules = merged.get("payments", []) + [
        ("fk_subscription", F.col("subscription_id").isNotNull() & F.col("_s_known").isNull(), F.col("subscription_id"))]
    lg = logs.join(known(users, "user_id", "_u"), F.col("user_id") == F.col("_u"), "left")
    log_rules = merged.get("logs", []) + [
        ("fk_user", F.col("user_id").isNotNull() & F.col("_u_known").isNull(), F.col("user_id"))]
    return _union([
        _row_rules(plans, "plans", merged.get("plans", [])),
        _row_rules(users, "users", merged.get("users", [])),
        _row_rules(subs, "subscriptions", sub_rules),
        _row_rules(pays, "payments", pay_rules),
        _row_rules(lg, "logs", log_rules),
        uniqueness(plans, users, payments, webhook_events)]
        + [_row_rules(df, t, merged[t]) for t, df in (("outbox", outbox), ("webhook_events", webhook_events)) if df is not None])
