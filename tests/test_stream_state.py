"""Micro-batches: replays, retries, late requests, null order keys; repeated commands in a batch."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from subsight.functions import json as J
from subsight.functions.predicates import blank_col
from subsight.operators import outbox as O
from subsight.operators import plan_jobs as PJ
from subsight.operators import ratelimit as RL
from subsight.operators import subscription_jobs as SUB
from subsight.operators import user_jobs as UJ
from subsight.operators import webhooks as W
from subsight.operators.changes import apply_upserts
from subsight.session import scratch_path
from subsight.sources import commands as C
from subsight.sources import schemas as S
from subsight.sources.tables import Tables
from subsight.streaming import jobs as SJ
from subsight.streaming import state as K
from subsight.streaming.landing import land

from .conftest import SF001

AS_OF = "2001-08-15 00:00:00"
KEY = "test-webhook-key"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF001)


def land_files(spark, folder, frames):
    """One file per frame, written one after another."""
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)


def breaking(handle, at, after):
    """The handler, failing once in batch ``at``: before or after its writes."""
    left = [1]

    def run(batch, bid, sink):
        if after:
            handle(batch, bid, sink)
        if bid == at and left[0]:
            left[0] = 0
            raise RuntimeError("lost driver")
        if not after:
            handle(batch, bid, sink)

    return run


@pytest.mark.parametrize("after", [True, False])
def test_webhook_batch_replay_changes_nothing(spark, t, after, monkeypatch):
    inbound = W.signed_inbound(t, KEY).select(*[F.col(f.name).cast(f.dataType) for f in S.WEBHOOK_IN.fields])
    cut = inbound.agg(F.expr("percentile(seq, 0.5)")).first()[0]
    landing, sink = scratch_path(spark, "replay-in"), scratch_path(spark, "replay")
    land_files(spark, landing, [inbound.where(F.col("seq") <= cut), inbound.where(F.col("seq") > cut)])
    make = SJ.ingest_batch
    monkeypatch.setattr(SJ, "ingest_batch", lambda *a: breaking(make(*a), 1, after))
    with pytest.raises(Exception, match="lost driver"):
        SJ.webhooks_stream(spark, landing, t.payments, t.outbox, KEY, sink=sink, files_per_trigger=1)
    monkeypatch.setattr(SJ, "ingest_batch", make)
    SJ.webhooks_stream(spark, landing, t.payments, t.outbox, KEY, sink=sink, files_per_trigger=1)
    ids = [r["outbox_id"] for r in spark.read.parquet(f"{sink}/outbox").collect()]
    assert len(ids) == len(set(ids)) and ids
    events = [r["event_id"] for r in spark.read.parquet(f"{sink}/events").collect()]
    assert len(events) == len(set(events))
    assert rows(spark.read.parquet(f"{sink}/dispositions").drop("batch")) == rows(
        W.ingest(inbound, t.payments, t.outbox, KEY, with_outbox=False)["dispositions"])


def test_hot_values_are_thinned_before_the_shuffle(spark):
    df = spark.range(0, 30000, 1, 2).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    assert K.distinct_values(df, "k").where("k = 'hot'").count() <= 30000 / 10000 + 2  # one for each Arrow batch
    limited = K.spread_excess(df, ["k"], ["seq"], 5)
    assert limited.where("spread = 0 AND k = 'hot'").count() <= 5 * (30000 / 10000 + 2)
    assert limited.where("spread > 0").groupBy("spread").count().agg(F.max("count")).first()[0] < 20000 / 30
    assert limited.count() == 30000 and limited.where("k <> 'hot' AND spread > 0").count() == 0


def test_read_errors_are_not_an_empty_sink(spark, tmp_path):
    (tmp_path / "events" / "batch=0").mkdir(parents=True)
    (tmp_path / "events" / "batch=0" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        SJ._batch(spark, str(tmp_path), "events", 0).collect()
    assert SJ._batch(spark, str(tmp_path), "events", 7) is None


OUT = [(1, "PaymentProcessed", '{"UserId":1,"PaymentId":5}', 0), (2, "PaymentProcessed", "{bad", 0), (3, "PaymentProcessed", '{"UserId":999999}', 3),
       (4, "PaymentRefunded", "[1]", 1), (5, "Notification.Email", "{bad", 0), (6, "PaymentProcessed", "{}", 5)]


def outbox(spark, data):
    now = dt.datetime(2001, 1, 1)
    return spark.createDataFrame([(i, k, p, now, None, a, None) for i, k, p, a in data], S.OUTBOX)


def test_outbox_retries_until_settled(spark, t):
    folder = scratch_path(spark, "outbox-in")
    land_files(spark, folder, [outbox(spark, some) for some in (OUT[:3], OUT[3:5], [(6, "PaymentProcessed", "{}", 0)])])
    sink = SJ.outbox_stream(spark, folder, S.OUTBOX, t.users, AS_OF, files_per_trigger=1, retry_after_ms=100)
    got = {r["outbox_id"]: (r["processed_at"] is not None, r["attempts"]) for r in SJ.outbox_final(spark, sink).collect()}
    assert got == {1: (True, 0), 2: (False, 5), 3: (False, 5), 4: (False, 5), 5: (True, 0), 6: (True, 0)}
    assert SJ.outbox_final(spark, sink).count() == 6  # each settled row once
    assert spark.read.parquet(f"{sink}/notifications").count() == 2
    # every attempt is one batch of the query: 5 for row 2, 2 for row 3, 4 for row 4
    tried = {r["outbox_id"]: r["n"] for r in spark.read.parquet(f"{sink}/results").groupBy("outbox_id").agg(F.count("*").alias("n")).collect()}
    assert tried == {1: 1, 2: 5, 3: 2, 4: 4, 5: 1, 6: 1}


def test_outbox_stops_between_attempts_and_resumes(spark, t):
    folder = scratch_path(spark, "outbox-in")
    land_files(spark, folder, [outbox(spark, OUT[:2])])
    sink = SJ.outbox_stream(spark, folder, S.OUTBOX, t.users.limit(0), AS_OF, retry_after_ms=300_000, settle=False)
    assert rows(spark.read.parquet(f"{sink}/results").select("outbox_id", "result", "attempts")) == [(1, "failed", 1), (2, "failed", 1)]
    assert SJ._waiting(spark, sink) == 2
    land_files(spark, folder, [outbox(spark, [(7, "PaymentRefunded", "{}", 0)])])
    SJ.outbox_stream(spark, folder, S.OUTBOX, t.users, AS_OF, sink=sink, retry_after_ms=100, settle=False)
    assert rows(spark.read.parquet(f"{sink}/notifications").select("outbox_id")) == [(7,)]
    assert SJ._waiting(spark, sink) == 2  # their timers, of the first run, have not come yet


def test_outbox_resumes_to_the_end(spark, t):
    folder = scratch_path(spark, "outbox-in")
    land_files(spark, folder, [outbox(spark, OUT[:2])])
    sink = SJ.outbox_stream(spark, folder, S.OUTBOX, t.users.limit(0), AS_OF, retry_after_ms=1000, settle=False)
    SJ.outbox_stream(spark, folder, S.OUTBOX, t.users, AS_OF, sink=sink, retry_after_ms=100)
    got = {r["outbox_id"]: (r["processed_at"] is not None, r["attempts"]) for r in SJ.outbox_final(spark, sink).collect()}
    assert got == {1: (True, got[1][1]), 2: (False, 5)} and 1 <= got[1][1] < 5
    assert rows(spark.read.parquet(f"{sink}/notifications").select("outbox_id")) == [(1,)]  # sent once


@pytest.mark.parametrize("payload,ok", [
    ('{"UserId":7}', True), ("{}", True), ('{"Amount":1.5,"Type":null}', True), ('{"UserId":"7"}', False), ("[1]", False), ('"x"', False),
    ('{"PaymentId":1.5}', False), ('{"UserId":null}', False), ('{"Amount":"3"}', False), ('{"Type":4}', False)])
def test_payload_kinds(spark, t, payload, ok):
    assert spark.range(1).select(J.payload_fits(F.lit(payload))).first()[0] is ok
    r = O.dispatch(outbox(spark, [(1, "PaymentRefunded", payload, 0)]), t.users, AS_OF)
    assert r["results"].first()["attempts"] == (0 if ok else 1)
    assert r["notifications"].count() == int(ok)


@pytest.mark.parametrize("body,ok", [('{"type":"a","amount":null}', False), ('{"type":"a","userId":null}', False), ('{"type":"a","status":null}', True)])
def test_webhook_null_numbers(spark, body, ok):
    assert spark.range(1).select(J.parse_webhook(F.lit(body))["valid"]).first()[0] is ok


def test_blank_is_any_white_space(spark):
    values = [(None, True), ("", True), (" ", True), ("\t\n", True), ("  ", True), (" x ", False)]
    df = spark.createDataFrame(values, "v string, want boolean")
    assert df.where(blank_col(F.col("v")) != F.col("want")).count() == 0


def test_limiter_decides_every_request(spark):
    day = dt.datetime(2001, 1, 10)
    at = lambda seq, minutes, client="a": (seq, day + dt.timedelta(minutes=minutes), client, None, None, "")
    first = [at(1, 0), at(2, 1), at(3, 2), at(4, 0, "b")]
    second = [at(5, 3), at(6, 60 * 24 * 3), at(7, 1, "b")]
    third = [at(8, -60 * 24 * 5), at(9, 4, "b"), at(10, 60 * 24 * 3 + 1)]
    landing, sink = scratch_path(spark, "limit-in"), scratch_path(spark, "limit")
    land_files(spark, landing, [spark.createDataFrame(x, S.WEBHOOK_IN) for x in (first, second)])
    with pytest.MonkeyPatch.context() as m:  # the second batch is replayed
        m.setattr(SJ, "limit_batch", breaking(SJ.limit_batch, 1, True))
        with pytest.raises(Exception, match="lost driver"):
            SJ.rate_limit_stream(spark, landing, "1 day", 2, "2 days", files_per_trigger=1, sink=sink)
    land_files(spark, landing, [spark.createDataFrame(third, S.WEBHOOK_IN)])
    SJ.rate_limit_stream(spark, landing, "1 day", 2, "2 days", files_per_trigger=1, sink=sink)
    got = {r["seq"]: (r["admitted"], r["late"]) for r in spark.read.parquet(f"{sink}/decisions").collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False), 4: (True, False), 5: (False, False), 6: (True, False),
                   7: (True, False), 8: (False, True), 9: (False, True), 10: (True, False)}


def test_limiter_decides_requests_without_a_time(spark):
    day = dt.datetime(2001, 1, 10)
    data = [(1, day, "a"), (2, None, "a"), (3, day, "a"), (4, None, "b")]
    want = {1: (True, None), 2: (False, "no_time"), 3: (False, "limit"), 4: (False, "no_time")}
    schema = "seq long, received_at timestamp_ntz, client_key string"
    landing = scratch_path(spark, "limit-null")
    full = spark.createDataFrame(data, schema)
    for c in ("event_id", "signature", "raw_payload"):
        full = full.withColumn(c, F.lit(None).cast("string"))
    land_files(spark, landing, [full])
    out = SJ.rate_limit_stream(spark, landing, "1 day", 1).collect()
    assert {r["seq"]: (r["admitted"], r["reason"]) for r in out} == want and len(out) == 4
    batch = RL.admit(full, "client_key", "received_at", "1 day", 1, ["received_at", "seq"], "seq").collect()
    assert {r["seq"]: r["admitted"] for r in batch} == {k: v[0] for k, v in want.items()} and len(batch) == 4


def test_landing_keeps_null_order_keys(spark):
    df = spark.createDataFrame([(None, 1), (3, 2), (1, 3), (None, 4), (2, 5), (9, 6)], "o long, x int")
    assert spark.read.parquet(land(df, "nulls", "o", chunks=3)).count() == 6


def plans(spark):
    now = dt.datetime(2001, 1, 1)
    from decimal import Decimal
    return spark.createDataFrame([(i, n, None, Decimal("1.00"), "Monthly", 30, None, now, None) for i, n in ((1, "A"), (2, "B"), (3, "C"))], S.PLANS)


def plan_cmds(spark, data):
    from decimal import Decimal
    return spark.createDataFrame([(*d, f"v{d[0]}", Decimal(d[0]), "Yearly", 365, None) for d in data],
                                 "seq long, plan_id long, name string, description string, price decimal(10,2), billing_cycle string, duration_days int, features string")


def test_repeated_plan_updates(spark):
    r = PJ.update(plans(spark), plan_cmds(spark, [(1, 1, "A2"), (2, 1, "A3"), (3, 2, "a2"), (4, 2, "C"), (5, 9, "Z"), (6, 3, "Z"), (7, 3, "z")]), AS_OF)
    reasons = {x["seq"]: x["reason"] for x in r.outcome.collect()}
    # the second command of plan 1 gives A2 up, so plan 2 may take it
    assert reasons == {1: None, 2: None, 3: None, 4: "name_taken", 5: "not_found", 6: None, 7: None}
    after = apply_upserts(plans(spark), r.upserts["plans"], "plan_id").collect()
    assert sorted((x["plan_id"], x["name"]) for x in after) == [(1, "A3"), (2, "a2"), (3, "z")]


def test_repeated_plan_upserts(spark):
    cmds = plan_cmds(spark, [(1, None, "New"), (2, None, "a"), (3, None, "NEW"), (4, None, "new"), (5, None, "A"), (6, None, "Other")]).drop("plan_id")
    r = PJ.upsert(plans(spark), cmds, AS_OF)
    assert {x["seq"]: (x["action"], x["plan_id"]) for x in r.outcome.collect()} == {
        1: ("inserted", 4), 2: ("updated", 1), 3: ("updated", 4), 4: ("updated", 4), 5: ("updated", 1), 6: ("inserted", 5)}
    after = {x["plan_id"]: (x["name"], x["description"], x["updated_at"] is not None) for x in
             apply_upserts(plans(spark), r.upserts["plans"], "plan_id").collect()}
    assert after == {1: ("A", "v5", True), 2: ("B", None, False), 3: ("C", None, False), 4: ("New", "v4", True), 5: ("Other", "v6", False)}


def test_repeated_user_updates(spark):
    now = dt.datetime(2001, 1, 1)
    users = spark.createDataFrame([(i, "F", "L", f"u{i}@x.org", None, None, now, "Subscriber") for i in (1, 2)], S.USERS)
    cmds = spark.createDataFrame([(1, 1, "F1", "L", "new@x.org", None, None, "Admin"), (2, 2, "F2", "L", "NEW@x.org", None, None, "Admin"),
                                  (3, 1, "F3", "L", "u1@x.org", None, None, "Admin")],
                                 "seq long, user_id long, first_name string, last_name string, email string, phone string, address string, role string")
    r = UJ.update(users, cmds, AS_OF)
    assert {x["seq"]: x["reason"] for x in r.outcome.collect()} == {1: None, 2: "email_taken", 3: None}
    after = apply_upserts(users, r.upserts["users"], "user_id").collect()
    assert sorted((x["user_id"], x["first_name"]) for x in after) == [(1, "F3"), (2, "F")]


def test_transaction_ids_of_two_batches_differ(spark, t):
    ids = []
    for as_of in (AS_OF, "2001-08-16 00:00:00"):
        r = SUB.renew(t.subscriptions, t.plans, t.payments, C.renewals(t), as_of)
        ids.append({x["transaction_id"] for x in r.upserts["payments"].select("transaction_id").collect()})
    assert ids[0] and ids[1] and not ids[0] & ids[1]
