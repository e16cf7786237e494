"""Property tests: invariants of the change jobs, paging and the
distributed ranking helpers (checked against brute force)."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from subsight.operators import ids
from subsight.operators import listing as L
from subsight.operators import ratelimit as RL
from subsight.operators import subscription_jobs as SJ
from subsight.plans.registry import AS_OF
from subsight.sources import commands as C
from subsight.sources.tables import Tables

from .conftest import SF001


def test_positions_dense_and_ordered(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 3 % 10007).alias("k"), F.col("id").alias("v")).repartition(5)
    got = ids.positions(df, ["k"]).select("k", "_pos").orderBy("k").collect()
    assert [r["_pos"] for r in got] == list(range(len(got)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 10**6)), min_size=1, max_size=60, unique_by=lambda x: x[1]))
def test_rank_within_matches_window(spark, rows):
    df = spark.createDataFrame(rows, "g int, seq long")
    got = {(r["g"], r["seq"]): r["rank"] for r in ids.rank_within(df, ["g"], ["seq"]).collect()}
    w = Window.partitionBy("g").orderBy("seq")
    want = {(r["g"], r["seq"]): r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 10**6)), min_size=1, max_size=80, unique_by=lambda x: x[1]),
       st.integers(1, 6))
def test_first_k_matches_brute_force(spark, rows, k):
    df = spark.createDataFrame(rows, "g int, seq long")
    got = {r["seq"]: r["admitted"] for r in RL.first_k(df, ["g"], ["seq"], k, "seq", salt_buckets=4).collect()}
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "0")  # the salted path too
    try:
        salted = {r["seq"]: r["admitted"] for r in RL.first_k(df, ["g"], ["seq"], k, "seq", salt_buckets=4).collect()}
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert salted == got
    want = {}
    for g in {r[0] for r in rows}:
        for i, s in enumerate(sorted(x[1] for x in rows if x[0] == g)):
            want[s] = i < k
    assert got == want


def test_hot_group_is_split(spark):
    # one client holds most requests: the admitted set is still exact
    df = spark.range(0, 20000).select(F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 7).alias("g"),
                                      F.col("id").alias("seq"))
    out = RL.first_k(df, ["g"], ["seq"], 30, "seq")
    got = out.where("admitted").groupBy("g").agg(F.max("seq").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["n"] == 30 for r in got)
    hot = sorted(i for i in range(20000) if (i % 10 < 8 or i % 7 == 0))[:30]
    assert [r["m"] for r in got if r["g"] == 0] == [hot[-1]]


def test_change_job_invariants(spark):
    t = Tables(spark, SF001)
    cancel = SJ.cancel(t.subscriptions, t.plans, t.payments, C.cancels(t), AS_OF)
    o = cancel.outcome
    assert o.count() == C.cancels(t).count()  # accepted + rejected = commands
    acc = o.where("accepted").join(t.subscriptions.select("subscription_id", "plan_id"), "subscription_id") \
        .join(t.plans.select("plan_id", "price"), "plan_id")
    assert acc.where((F.col("refund_amount") < 0) | (F.col("refund_amount") > F.col("price"))).count() == 0
    renew = SJ.renew(t.subscriptions, t.plans, t.payments, C.renewals(t), AS_OF)
    r = renew.upserts["subscriptions"].join(t.plans.select("plan_id", "duration_days"), "plan_id")
    bad = r.where(F.col("end_date") < F.timestamp_add("DAY", F.col("duration_days"), F.to_timestamp_ntz(F.lit(AS_OF))))
    assert bad.count() == 0


def test_expire_is_idempotent(spark):
    from subsight.operators.changes import apply_upserts
    t = Tables(spark, SF001)
    once = apply_upserts(t.subscriptions, SJ.expire_due(t.subscriptions, AS_OF).upserts["subscriptions"], "subscription_id")
    assert SJ.expire_due(once, AS_OF).outcome.count() == 0


def test_pages_concatenate_to_full_sort(spark):
    t = Tables(spark, SF001)
    req = lambda p: L.PageRequest(page=p, page_size=7, sort_by="price", sort_dir="asc")
    total = L.total(L.plans_filtered(t.plans)).first()[0]
    pages = []
    for p in range(1, -(-total // 7) + 1):
        pages += [r["plan_id"] for r in L.plans_page(t.plans, req(p)).collect()]
    full = [r["plan_id"] for r in t.plans.orderBy("price", "plan_id").collect()]
    assert pages == full


def test_page_validation():
    import pytest
    with pytest.raises(ValueError):
        L.PageRequest(page=0).validate()
    with pytest.raises(ValueError):
        L.PageRequest(page_size=201).validate()


def test_subscribe_ids_continue_tables(spark):
    t = Tables(spark, SF001)
    ch = SJ.subscribe(t.users, t.plans, t.subscriptions, t.payments, C.subscribes(t), AS_OF)
    new = ch.upserts["subscriptions"].select("subscription_id").orderBy("subscription_id").collect()
    top = t.subscriptions.agg(F.max("subscription_id")).first()[0]
    assert [r[0] for r in new] == list(range(top + 1, top + 1 + len(new)))
    assert ch.logs.count() == 2 * len(new) and ch.notifications.count() == len(new)
    amounts = ch.upserts["payments"].agg(F.sum("amount")).first()[0]
    assert amounts is None or amounts > Decimal(0)


def test_two_renewals_in_one_batch(spark):
    import datetime as dt
    subs = spark.createDataFrame(
        [(1, 5, 1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 31), None, "Active", True),
         (2, 6, 1, dt.datetime(2019, 1, 1), dt.datetime(2019, 1, 31), None, "Cancelled", False)],
        "subscription_id int, user_id int, plan_id int, start_date timestamp_ntz, end_date timestamp_ntz, "
        "renewal_date timestamp_ntz, status string, auto_renew boolean")
    plans = spark.createDataFrame([(1, "P", None, Decimal("10.00"), "Monthly", 30, None, dt.datetime(2019, 1, 1), None)],
                                  "plan_id int, name string, description string, price decimal(10,2), billing_cycle string, "
                                  "duration_days int, features string, created_at timestamp_ntz, updated_at timestamp_ntz")
    pays = spark.createDataFrame([(7, 1, Decimal("10.00"), dt.datetime(2020, 1, 1), None, "t", "Completed")],
                                 "payment_id int, subscription_id int, amount decimal(10,2), payment_date timestamp_ntz, "
                                 "payment_method string, transaction_id string, status string")
    cmds = spark.createDataFrame([(10, 1, 5, "PayPal"), (11, 1, 5, "PayPal"), (12, 2, 6, "PayPal"), (13, 1, 9, "PayPal")],
                                 "seq long, subscription_id int, user_id int, payment_method string")
    ch = SJ.renew(subs, plans, pays, cmds, "2020-01-10 00:00:00")
    out = {r["seq"]: r for r in ch.outcome.collect()}
    assert out[10]["new_end"] == dt.datetime(2020, 3, 1) and out[11]["new_end"] == dt.datetime(2020, 3, 31)
    assert (out[10]["payment_id"], out[11]["payment_id"]) == (8, 9)
    assert out[12]["reason"] == "cancelled" and out[13]["reason"] == "not_owner"
    final = ch.upserts["subscriptions"].collect()
    assert len(final) == 1 and final[0]["end_date"] == dt.datetime(2020, 3, 31) and final[0]["status"] == "Active"
    assert ch.upserts["payments"].count() == 2


def test_publish_writes_every_output_then_marker(spark):
    import os

    from subsight.session import scratch_path
    from subsight.sources.sinks import publish
    t = Tables(spark, SF001)
    ch = SJ.expire_due(t.subscriptions, AS_OF)
    base = scratch_path(spark, "publish-test")
    out = publish(ch, base)
    assert set(out) == {"outcome", "upserts/subscriptions", "logs", "notifications"}
    local = base.replace("file:", "")
    assert os.path.exists(os.path.join(local, "_PUBLISHED"))
    assert spark.read.parquet(out["logs"]).count() == ch.outcome.count()


def test_hot_event_id_and_hot_payment(spark):
    """A third of all requests share one event id and most hit one payment:
    results equal a brute-force serial replay."""
    import datetime as dt

    from subsight.functions.hmac import hmac_sha256_base64
    from subsight.operators import webhooks as W
    from subsight.sources import schemas as S

    n = 3000
    base = spark.range(0, n).select(
        F.col("id").alias("seq"), F.timestamp_add("SECOND", F.col("id"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).alias("received_at"),
        F.lit("c").alias("client_key"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("e"), F.col("id").cast("string"))).alias("event_id"),
        F.concat(F.lit('{"type":"payment.succeeded","transactionId":"TXN-'),
                 F.when(F.col("id") % 4 == 0, F.lit("1")).otherwise(F.col("id").cast("string")),
                 F.lit('","status":"'), F.when(F.col("id") % 2 == 0, F.lit("Failed")).otherwise(F.lit("Completed")),
                 F.lit('"}')).alias("raw_payload"))
    rows = base.withColumn("signature", hmac_sha256_base64(F.col("raw_payload"), "k"))
    pays = spark.range(1, n).select(F.col("id").cast("int").alias("payment_id"), F.lit(1).alias("subscription_id"),
                                    F.lit(1).cast(S.MONEY).alias("amount"), F.lit(dt.datetime(2020, 1, 1)).cast(S.TS).alias("payment_date"),
                                    F.lit(None).cast("string").alias("payment_method"),
                                    F.concat(F.lit("TXN-"), F.col("id").cast("string")).alias("transaction_id"),
                                    F.lit("Completed").alias("status"))
    res = W.ingest(rows, pays, spark.createDataFrame([], S.OUTBOX), "k", with_outbox=False)
    got = {r["seq"]: r["disposition"] for r in res["dispositions"].collect()}
    seen, want, last = set(), {}, {}
    for i in range(n):
        eid = "hot" if i % 3 == 0 else f"e{i}"
        want[i] = "duplicate" if eid in seen else "accepted"
        seen.add(eid)
        if want[i] == "accepted":
            txn = 1 if i % 4 == 0 else i
            if 1 <= txn < n:
                last[txn] = "Failed" if i % 2 == 0 else "Completed"
    assert got == want
    upd = {r["payment_id"]: r["status"] for r in res["payment_updates"].collect()}
    assert upd == last


def test_mixed_batch_equals_serial_replay(spark):
    """The closed form of the mixed renew/cancel batch against a plain
    serial replay of the same commands (small fixture, whole tables)."""
    import datetime as dt
    from decimal import ROUND_HALF_UP

    t = Tables(spark, SF001)
    as_of = dt.datetime.fromisoformat(AS_OF)
    plans = {r["plan_id"]: (r["price"], r["duration_days"]) for r in t.plans.collect()}
    subs = {r["subscription_id"]: dict(owner=r["user_id"], status=r["status"], end=r["end_date"],
                                       plan=plans[r["plan_id"]]) for r in t.subscriptions.collect()}
    latest = {}
    for r in t.payments.where("status = 'Completed'").collect():
        cur = latest.get(r["subscription_id"])
        if cur is None or (r["payment_date"], r["payment_id"]) > cur:
            latest[r["subscription_id"]] = (r["payment_date"], r["payment_id"])
    next_pid = t.payments.agg(F.max("payment_id")).first()[0] + 1
    want = {}
    for c in sorted(C.mixed_commands(t).collect(), key=lambda r: r["seq"]):
        s = subs.get(c["subscription_id"])
        if s is None:
            want[c["seq"]] = ("not_found", None, None)
        elif s["owner"] != c["user_id"]:
            want[c["seq"]] = ("not_owner", None, None)
        elif c["kind"] == "renew":
            if s["status"] == "Cancelled":
                want[c["seq"]] = ("cancelled", None, None)
            else:
                price, dur = s["plan"]
                s["end"] = max(s["end"], as_of) + dt.timedelta(days=dur)
                s["status"] = "Active"
                cur = latest.get(c["subscription_id"])
                if cur is None or (as_of, next_pid) > cur:
                    latest[c["subscription_id"]] = (as_of, next_pid)
                want[c["seq"]] = (None, next_pid, s["end"])
                next_pid += 1
        else:
            if s["status"] != "Active":
                want[c["seq"]] = ("not_active", None, None)
            else:
                price, dur = s["plan"]
                rem = min(max((s["end"].date() - as_of.date()).days, 0), dur)
                refund = (price * rem / dur).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP) if rem > 0 else Decimal("0.00")
                lp = latest.get(c["subscription_id"])
                want[c["seq"]] = (None, refund, lp[1] if (refund > 0 and lp) else None)
                s["status"], s["end"] = "Cancelled", as_of
    got = {}
    for r in SJ.mixed(t.subscriptions, t.plans, t.payments, C.mixed_commands(t), AS_OF).outcome.collect():
        if r["reason"] is not None:
            got[r["seq"]] = (r["reason"], None, None)
        elif r["kind"] == "renew":
            got[r["seq"]] = (None, r["payment_id"], r["new_end"])
        else:
            got[r["seq"]] = (None, r["refund_amount"], r["refunded_payment_id"])
    assert got == want


def test_replaying_webhooks_changes_nothing(spark):
    from subsight.operators import webhooks as W
    from subsight.plans.registry import HMAC_TEST_KEY
    t = Tables(spark, SF001)
    rows = W.signed_inbound(t, HMAC_TEST_KEY)
    first = W.ingest(rows, t.payments, t.outbox, HMAC_TEST_KEY, with_outbox=False)
    stored = first["events"].select("event_id")
    again = W.ingest(rows, t.payments, t.outbox, HMAC_TEST_KEY, known_event_ids=stored, with_outbox=False)
    # every authenticated request with an event id is now a duplicate: no update, no outbox row
    assert again["payment_updates"].count() == 0
    assert again["dispositions"].where("disposition = 'accepted'").count() == 0
    assert again["dispositions"].where("disposition = 'duplicate'").count() == \
        first["dispositions"].where("disposition IN ('accepted', 'duplicate', 'malformed')").count()


def test_hot_subscription_cancel_commands(spark):
    """Hundreds of cancels for one subscription: exactly the first with the
    right owner is accepted, as serial processing decides."""
    import datetime as dt
    subs = spark.createDataFrame([(1, 5, 1, dt.datetime(2020, 1, 1), dt.datetime(2020, 3, 1), None, "Active", True),
                                  (2, 6, 1, dt.datetime(2020, 1, 1), dt.datetime(2020, 3, 1), None, "Active", True)],
                                 "subscription_id int, user_id int, plan_id int, start_date timestamp_ntz, end_date timestamp_ntz, "
                                 "renewal_date timestamp_ntz, status string, auto_renew boolean")
    plans = spark.createDataFrame([(1, "P", None, Decimal("30.00"), "Monthly", 30, None, dt.datetime(2019, 1, 1), None)],
                                  "plan_id int, name string, description string, price decimal(10,2), billing_cycle string, "
                                  "duration_days int, features string, created_at timestamp_ntz, updated_at timestamp_ntz")
    pays = spark.createDataFrame([], "payment_id int, subscription_id int, amount decimal(10,2), payment_date timestamp_ntz, "
                                     "payment_method string, transaction_id string, status string")
    cmds = spark.range(0, 500).select(F.col("id").alias("seq"), F.when(F.col("id") == 499, 2).otherwise(1).alias("subscription_id"),
                                      F.when(F.col("id") < 3, 9).when(F.col("id") == 499, 6).otherwise(5).alias("user_id"))
    out = {r["seq"]: r["reason"] for r in SJ.cancel(subs, plans, pays, cmds, "2020-02-01 00:00:00").outcome.collect()}
    assert out[0] == out[1] == out[2] == "not_owner"
    assert out[3] is None and out[499] is None
    assert all(out[i] == "not_active" for i in range(4, 499))
