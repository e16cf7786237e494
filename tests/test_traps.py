"""Unit tests for the traps of the reference."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from subsight.functions import money as M
from subsight.functions.dates import day_diff, in_range, lit_ts
from subsight.operators import outbox as O
from subsight.operators import payment_jobs as PJ
from subsight.operators import reports as R
from subsight.operators import views as V
from subsight.operators import webhooks as W
from subsight.sources import schemas as S

SUBS = "subscription_id int, user_id int, plan_id int, start_date timestamp_ntz, end_date timestamp_ntz, " \
       "renewal_date timestamp_ntz, status string, auto_renew boolean"
PAYS = "payment_id int, subscription_id int, amount decimal(10,2), payment_date timestamp_ntz, " \
       "payment_method string, transaction_id string, status string"
PLANS = "plan_id int, name string, description string, price decimal(10,2), billing_cycle string, " \
        "duration_days int, features string, created_at timestamp_ntz, updated_at timestamp_ntz"


def T(s):
    return dt.datetime.fromisoformat(s)


def test_upper_bound_adds_one_day_to_value_given(spark):
    # D7: 'to' with a time of day reaches 24 h past it
    df = spark.createDataFrame([(T("2020-01-02 11:00:00"),), (T("2020-01-02 13:00:00"),)], "ts timestamp_ntz")
    got = df.where(in_range(F.col("ts"), None, "2020-01-01 12:00:00")).count()
    assert got == 1


def test_day_diff_counts_midnights(spark):
    df = spark.createDataFrame([(T("2020-01-01 23:59:59"), T("2020-01-02 00:00:01"))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(day_diff(F.col("b"), F.col("a"))).first()[0] == 1


def test_half_cent_rounds_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("0.05"), 1, 2), (Decimal("10.00"), 1, 3), (Decimal("9.99"), 0, 30),
                                (Decimal("2.345"), 1, 1)], "a decimal(10,3), r int, d int")
    got = [x[0] for x in df.select(M.prorata(F.col("a").cast("decimal(10,2)"), F.col("r"), F.col("d"))).collect()]
    assert got == [Decimal("0.03"), Decimal("3.33"), Decimal("0.00"), Decimal("2.35")]


def test_empty_tables_give_zero(spark):
    subs = spark.createDataFrame([], SUBS)
    pays = spark.createDataFrame([], PAYS)
    assert R.revenue(pays, "2020-01-01", "2020-12-31").first()[0] == Decimal("0.00")
    assert R.churn_rate(subs).first()[0] == 0.0
    assert R.avg_duration_days(subs).first()[0] == 0.0


def test_latest_payment_tie_breaks_on_id(spark):
    d = T("2020-01-01 00:00:00")
    pays = spark.createDataFrame([(1, 7, Decimal("1.00"), d, None, "a", "Completed"),
                                  (2, 7, Decimal("2.00"), d, None, "b", "Completed"),
                                  (3, 7, Decimal("3.00"), T("2021-01-01 00:00:00"), None, "c", "Refunded")], PAYS)
    assert V.latest_completed_payment(pays).first()["payment_id"] == 2


def test_refund_decides_from_old_values(spark):
    # D-trap: every CASE of the update sees the old status and end date
    as_of = "2020-01-10 00:00:00"
    subs = spark.createDataFrame([(1, 5, 1, T("2020-01-01 00:00:00"), T("2020-01-31 00:00:00"), None, "Active", True),
                                  (2, 5, 1, T("2019-01-01 00:00:00"), T("2019-01-31 00:00:00"), None, "Expired", True)], SUBS)
    plans = spark.createDataFrame([(1, "P", None, Decimal("30.00"), "Monthly", 30, None, T("2019-01-01 00:00:00"), None)], PLANS)
    pays = spark.createDataFrame([(10, 1, Decimal("30.00"), T("2020-01-01 00:00:00"), None, "t1", "Completed"),
                                  (11, 1, Decimal("30.00"), T("2020-01-02 00:00:00"), None, "t2", "Completed"),
                                  (20, 2, Decimal("30.00"), T("2019-01-01 00:00:00"), None, "t3", "Refunded")], PAYS)
    cmds = spark.createDataFrame([(1, 10), (2, 11), (3, 20)], "seq long, payment_id int")
    ch = PJ.refund(pays, subs, plans, cmds, as_of)
    out = {r["seq"]: r for r in ch.outcome.collect()}
    assert out[1]["remaining_days"] == 21 and out[1]["refund_estimate"] == Decimal("21.00")
    assert out[2]["remaining_days"] == 0  # the first refund already cancelled it
    assert out[3]["already_refunded"] is True
    s = {r["subscription_id"]: r for r in ch.upserts["subscriptions"].collect()}
    assert s[1]["status"] == "Cancelled" and s[1]["end_date"] == T(as_of) and s[1]["auto_renew"] is False
    assert s[2]["status"] == "Expired" and s[2]["end_date"] == T("2019-01-31 00:00:00")


def test_duplicate_webhook_has_no_effect(spark):
    key = "k"
    body = '{"type":"payment.succeeded","transactionId":"TXN-1","status":"Failed","amount":1.00}'
    rows = spark.createDataFrame([(1, T("2020-01-01 00:00:00"), "c", "e1", body), (2, T("2020-01-01 00:00:01"), "c", "e1", body),
                                  (3, T("2020-01-01 00:00:02"), "c", "e2", "{bad"), (4, T("2020-01-01 00:00:03"), "c", None, body)],
                                 "seq long, received_at timestamp_ntz, client_key string, event_id string, raw_payload string")
    from subsight.functions.hmac import hmac_sha256_base64
    signed = rows.withColumn("signature", hmac_sha256_base64(F.col("raw_payload"), key))
    signed = signed.unionByName(rows.where("seq = 1").withColumn("seq", F.lit(5).cast("long"))
                                .withColumn("event_id", F.lit("e3")).withColumn("signature", F.lit("forged")))
    pays = spark.createDataFrame([(1, 1, Decimal("1.00"), T("2019-01-01 00:00:00"), None, "TXN-1", "Completed")], PAYS)
    box = spark.createDataFrame([], S.OUTBOX)
    res = W.ingest(signed, pays, box, key)
    d = {r["seq"]: r["disposition"] for r in res["dispositions"].collect()}
    assert d == {1: "accepted", 2: "duplicate", 3: "malformed", 4: "missing_event_id", 5: "unauthorized"}
    upd = res["payment_updates"].collect()
    assert [(u["payment_id"], u["status"]) for u in upd] == [(1, "Failed")]
    assert res["outbox"].count() == 1


def test_zero_user_id_means_no_user(spark):
    box = spark.createDataFrame(
        [(1, "PaymentProcessed", '{"UserId":0,"SubscriptionId":3,"PaymentId":4,"Amount":1.50}', T("2020-01-01 00:00:00"), None, 0, None),
         (2, "PaymentProcessed", '{"UserId":99,"SubscriptionId":3,"PaymentId":5,"Amount":1.50}', T("2020-01-01 00:00:00"), None, 4, None),
         (3, "PaymentRefunded", "not json", T("2020-01-01 00:00:00"), None, 0, None),
         (4, "Other", "x", T("2020-01-01 00:00:00"), None, 0, None)], S.OUTBOX)
    users = spark.createDataFrame([(1,)], "user_id int")
    res = O.dispatch(box, users, "2020-02-01 00:00:00")
    r = {x["outbox_id"]: x for x in res["results"].collect()}
    assert r[1]["result"] == "processed" and r[1]["user_id"] is None
    assert r[2]["result"] == "failed" and r[2]["attempts"] == 5
    assert r[3]["result"] == "failed" and r[4]["result"] == "processed"
    assert res["notifications"].count() == 1  # one per successful payment row, none for failures
    out = {x["outbox_id"]: x for x in res["outbox"].collect()}
    assert out[2]["processed_at"] is None and out[2]["error"].startswith("Log user 99")
    assert O.dead_letter(res["outbox"]).count() == 1


def test_currency_text_lakh_grouping(spark):
    vals = ["0.50", "999.00", "1000.00", "123456.78", "12345678.90", "-1234.50"]
    df = spark.createDataFrame([(Decimal(v),) for v in vals], "a decimal(18,2)")
    got = [r[0] for r in df.select(M.currency_inr(F.col("a"))).collect()]
    assert got == ["₹0.50", "₹999.00", "₹1,000.00", "₹1,23,456.78", "₹1,23,45,678.90", "-₹1,234.50"]


def test_hmac_matches_python(spark):
    import base64
    import hashlib
    import hmac

    from subsight.functions.hmac import hmac_sha256_base64
    key = "k" * 80  # longer than one block: hashed first
    body = '{"a":"ü"}'
    want = base64.b64encode(hmac.new(key.encode(), body.encode(), hashlib.sha256).digest()).decode()
    assert spark.range(1).select(hmac_sha256_base64(F.lit(body), key)).first()[0] == want


def test_literal_timestamp_folds(spark):
    assert spark.range(1).select(lit_ts("2020-01-02")).first()[0] == T("2020-01-02 00:00:00")


def test_message_texts(spark, seed):
    from subsight.operators import subscription_jobs as SJ
    from .conftest import SEED_AS_OF
    cmds = spark.createDataFrame([(1, 2, 10, "PayPal", True)], "seq long, user_id int, plan_id int, payment_method string, auto_renew boolean")
    ch = SJ.subscribe(seed["users"], seed["plans"], seed["subscriptions"], seed["payments"], cmds, SEED_AS_OF)
    logs = sorted(r["message"] for r in ch.logs.collect())
    assert logs == ["Payment 26 completed for subscription 31 amount ₹999.00.",
                    "User 2 subscribed to Plan Enterprise Yearly (PlanId=10), SubId=31."]
    assert ch.notifications.first()["body"] == "Your subscription (ID 31) to Enterprise Yearly is active."
    cancel = spark.createDataFrame([(1, 1, 1)], "seq long, subscription_id int, user_id int")
    c = SJ.cancel(seed["subscriptions"], seed["plans"], seed["payments"], cancel, SEED_AS_OF)
    msg = c.logs.first()["message"]
    assert msg.startswith("Subscription 1 cancelled. Pro‑rata refund: ₹") and msg.endswith(" for plan Basic Monthly.")
