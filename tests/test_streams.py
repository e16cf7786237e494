"""Streams equal their batch jobs, also across a stop and restart."""

from pyspark.sql import functions as F

from subsight.operators import webhooks as W
from subsight.plans.registry import HMAC_TEST_KEY
from subsight.session import scratch_path
from subsight.sources import schemas as S
from subsight.sources.tables import Tables
from subsight.streaming import jobs as SJ

from .conftest import SF001


def _conform(df):
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.WEBHOOK_IN.fields])


def test_webhook_stream_restart_equals_batch(spark):
    t = Tables(spark, SF001)
    rows = _conform(W.signed_inbound(t, HMAC_TEST_KEY))
    cut = rows.approxQuantile("seq", [0.5], 0.0)[0]
    landing = scratch_path(spark, "landing-restart")
    sink = scratch_path(spark, "sink-restart")
    # one file per arrival, so the file source sees them in order
    rows.where(F.col("seq") <= cut).coalesce(1).write.parquet(landing)
    first = SJ.webhooks_stream(spark, landing, t.payments, t.outbox, HMAC_TEST_KEY, sink=sink).count()
    # the query stops; more requests arrive; the same checkpoint resumes it
    rows.where(F.col("seq") > cut).coalesce(1).write.mode("append").parquet(landing)
    streamed = SJ.webhooks_stream(spark, landing, t.payments, t.outbox, HMAC_TEST_KEY, sink=sink)
    batch = W.ingest(rows, t.payments, t.outbox, HMAC_TEST_KEY, with_outbox=False)["dispositions"]
    cols = ["seq", "event_id", "disposition", "target_payment_id"]
    assert 0 < first < streamed.count() == rows.count()
    assert sorted(map(tuple, streamed.select(cols).collect()), key=str) == sorted(map(tuple, batch.select(cols).collect()), key=str)
    # duplicates across the two runs are caught by the stored event ids
    assert streamed.where("disposition = 'duplicate'").count() == batch.where("disposition = 'duplicate'").count()
    # outbox rows of both runs: ids continue the table in arrival order, as one batch run gives
    box = SJ.webhook_stream_output(spark, sink, "outbox").select("outbox_id", "type", "payload", "created_at")
    want = W.ingest(rows, t.payments, t.outbox, HMAC_TEST_KEY)["outbox"].select("outbox_id", "type", "payload", "created_at")
    assert sorted(map(tuple, box.collect())) == sorted(map(tuple, want.collect()))


def test_log_stream_quarantines_unknown_users(spark):
    import datetime as dt

    from subsight.streaming.landing import land
    msgs = spark.createDataFrame(
        [(1, "UserLogin", "a", dt.datetime(2024, 1, 1, 0, 0, 1)), (None, "ReportRevenue", "b", dt.datetime(2024, 1, 1, 0, 0, 2)),
         (999, "UserLogin", "c", dt.datetime(2024, 1, 1, 0, 0, 3)), (2, "UserLogin", "d", dt.datetime(2024, 1, 1, 0, 0, 4))],
        S.LOG_MESSAGE).withColumn("_o", F.unix_micros(F.col("timestamp_utc").cast("timestamp")))
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    out = SJ.logs_stream(spark, land(msgs, "logs-test", "_o", chunks=2), users)
    got = {r["message"]: r["sink"] for r in out.collect()}
    assert got == {"a": "logs", "b": "logs", "c": "quarantine", "d": "logs"}
