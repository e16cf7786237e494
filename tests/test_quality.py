"""Each data-quality rule fires on a hand-broken row and only there."""

import datetime as dt
from decimal import Decimal

from subsight.operators import quality as Q

D = dt.datetime(2020, 1, 1)
PLANS = "plan_id int, name string, description string, price decimal(10,2), billing_cycle string, duration_days int, " \
        "features string, created_at timestamp_ntz, updated_at timestamp_ntz"
USERS = "user_id int, first_name string, last_name string, email string, phone string, address string, " \
        "registration_date timestamp_ntz, role string"
SUBS = "subscription_id int, user_id int, plan_id int, start_date timestamp_ntz, end_date timestamp_ntz, " \
       "renewal_date timestamp_ntz, status string, auto_renew boolean"
PAYS = "payment_id int, subscription_id int, amount decimal(10,2), payment_date timestamp_ntz, payment_method string, " \
       "transaction_id string, status string"
LOGS = "log_id int, user_id int, action string, message string, log_date timestamp_ntz"


def _tables(spark):
    plans = spark.createDataFrame([
        (1, "Basic", None, Decimal("9.99"), "Monthly", 30, None, D, None),
        (2, "basic", None, Decimal("-1.00"), "Monthly", 0, None, D, None),        # dup name, negative price, zero days
        (3, " ", None, Decimal("5.00"), "M" * 21, 30, None, D, None),            # blank name, cycle too long
        (4, "Huge", None, Decimal("1000000.00"), "Yearly", 2001, None, D, None),  # out of form ranges
    ], PLANS)
    users = spark.createDataFrame([
        (1, "Ann", "Lee", "ann@example.com", "555-0101", None, D, "Admin"),
        (2, "Bob", "Ray", "ANN@example.com", "(555) 0102 x12", None, D, "Subscriber"),  # dup e-mail
        (3, "Cy", "Ho", "@bad", "phone!", None, D, "Subscriber"),                        # bad e-mail and phone
        (4, "Di", "Xu", "two@@x.com", None, None, D, "Subscriber"),                      # two @
    ], USERS)
    subs = spark.createDataFrame([
        (1, 1, 1, D, D, None, "Active", True),      # admin holds it
        (2, 2, 9, D, D, None, "Paused", False),     # unknown plan, bad status
        (3, 7, 1, D, D, None, "Expired", False),    # unknown user
    ], SUBS)
    pays = spark.createDataFrame([
        (1, 1, Decimal("9.99"), D, "Card", "T1", "Completed"),
        (2, 5, Decimal("-2.00"), D, "Card", "T1", "Pending"),  # orphan, negative, dup txn, bad status
    ], PAYS)
    logs = spark.createDataFrame([(1, None, "A", None, D), (2, 99, "", None, D)], LOGS)  # unknown user, blank action
    return users, plans, subs, pays, logs


def test_every_rule_fires_where_broken(spark):
    users, plans, subs, pays, logs = _tables(spark)
    got = {(r["table_name"], r["rule"], r["key"]) for r in Q.all_violations(users, plans, subs, pays, logs).collect()}
    want = {
        ("plans", "price_non_negative", "2"), ("plans", "duration_positive", "2"),
        ("plans", "price_range", "2"), ("plans", "duration_range", "2"),
        ("plans", "price_range", "4"), ("plans", "duration_range", "4"),
        ("plans", "required_name", "3"), ("plans", "max_length_billing_cycle", "3"),
        ("plans", "unique_name", "basic"),
        ("payments", "amount_non_negative", "2"), ("payments", "amount_range", "2"),
        ("payments", "status_enum", "2"), ("payments", "unique_transaction_id", "T1"),
        ("payments", "fk_subscription", "2"),
        ("subscriptions", "status_enum", "2"), ("subscriptions", "fk_plan", "2"),
        ("subscriptions", "fk_user", "3"), ("subscriptions", "admin_holds_subscription", "1"),
        ("users", "unique_email", "ann@example.com"), ("users", "email_shape", "3"), ("users", "email_shape", "4"),
        ("users", "phone_shape", "3"),
        ("logs", "fk_user", "2"), ("logs", "required_action", "2"),
    }
    assert got == want


def test_families_agree_with_full_report(spark):
    users, plans, subs, pays, logs = _tables(spark)
    full = {tuple(r) for r in Q.all_violations(users, plans, subs, pays, logs).collect()}
    parts = set()
    for df in (Q.domain(plans, pays), Q.statuses(subs, pays), Q.uniqueness(plans, users, pays),
               Q.foreign_keys(users, plans, subs, pays, logs),
               Q.required({"users": users, "plans": plans, "subscriptions": subs, "payments": pays, "logs": logs}),
               Q.ranges(plans, pays), Q.email_phone(users), Q.admin_subscriptions(users, subs)):
        parts |= {tuple(r) for r in df.collect()}
    assert parts == full
