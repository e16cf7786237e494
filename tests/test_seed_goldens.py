"""Hand-derived goldens on the 30-subscription seed (rules in FIXTURES.md)."""

from decimal import Decimal

from pyspark.sql import functions as F

from subsight.operators import quality as Q
from subsight.operators import reports as R
from subsight.operators import subscription_jobs as SJ

from .conftest import SEED_AS_OF


def test_status_counts(seed):
    got = {r["status"]: r["count"] for r in seed["subscriptions"].groupBy("status").count().collect()}
    assert got == {"Active": 23, "Expired": 4, "Cancelled": 3}


def test_churn_and_mean_duration(seed):
    assert R.churn_rate(seed["subscriptions"]).first()[0] == 0.1
    assert R.avg_duration_days(seed["subscriptions"]).first()[0] == 197.5


def test_plan_metrics(seed):
    rows = R.plan_metrics(seed["subscriptions"], seed["plans"]).collect()
    assert len(rows) == 10 and all(r["total_subscriptions"] == 3 for r in rows)
    ent = [r for r in rows if r["plan_name"] == "Enterprise Yearly"][0]
    assert ent["cancelled_subscriptions"] == 3 and ent["churn_rate"] == 1.0
    assert sum(r["cancelled_subscriptions"] for r in rows) == 3
    assert [r["plan_name"] for r in rows] == sorted(r["plan_name"] for r in rows)


def test_payment_totals(seed):
    p = seed["payments"]
    assert R.payments_total(p).first()["total_amount"] == Decimal("4967.87")
    c = R.payments_total(p, status="Completed").first()
    assert (c["total_amount"], c["payment_count"]) == (Decimal("4937.88"), 24)
    r = R.payments_total(p, status="refunded").first()
    assert (r["total_amount"], r["payment_count"]) == (Decimal("29.99"), 1)
    methods = {x["payment_method"]: x["count"] for x in p.groupBy("payment_method").count().collect()}
    assert methods == {"PayPal": 8, "Credit Card": 17}


def test_expired_report(seed):
    got = {r["plan_id"]: r["expired_count"] for r in R.expired_by_plan(seed["subscriptions"], seed["plans"], SEED_AS_OF).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 1, 7: 3, 8: 1, 9: 2}


def test_due_for_expiry(seed):
    due = SJ.expire_due(seed["subscriptions"], SEED_AS_OF).outcome
    assert sorted(r["subscription_id"] for r in due.collect()) == [11, 12, 13, 17, 19, 22, 23, 27, 29]


def test_log_actions(seed):
    got = {r["action"]: r["count"] for r in seed["logs"].groupBy("action").count().collect()}
    assert got == {"UserRegistered": 14, "SubscriptionCancelled": 9, "PaymentProcessed": 8, "UserLogin": 7,
                   "SubscriptionCreated": 6, "SubscriptionRenewed": 6}
    assert seed["logs"].where(F.col("user_id").isNull()).count() == 10


def test_admin_rule(seed):
    assert Q.admin_subscriptions(seed["users"], seed["subscriptions"]).count() == 10
