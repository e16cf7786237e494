"""What must not grow with the tables: broadcasts, micro-batches, texts in shuffles, payments read for nothing."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from subsight.operators import ids
from subsight.operators import plan_jobs as PL
from subsight.operators import quality as Q
from subsight.operators import subscription_jobs as SUB
from subsight.operators import webhooks as W
from subsight.functions.hmac import hmac_sha256_base64
from subsight.session import scratch_path
from subsight.sources import commands as C
from subsight.sources import schemas as S
from subsight.sources.tables import Tables
from subsight.streaming.landing import files_a_batch, land

from .conftest import SF001

AS_OF = "2001-08-15 00:00:00"
KEY = "test-webhook-key"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_millions_of_keys_are_not_broadcast(spark):
    path = scratch_path(spark, "keys")
    spark.range(2_000_000).select(F.col("id").alias("user_id")).write.parquet(path)
    parents = spark.read.parquet(path)
    children = parents.select((F.col("user_id") + 5).alias("user_id"), F.col("user_id").alias("log_id"))
    orphans = Q._orphans(children, "logs", "fk_user", "user_id", parents, "user_id")
    assert {r["value"] for r in orphans.collect()} == {str(2_000_000 + i) for i in range(5)}
    assert "BroadcastHashJoin" not in plan(orphans)


def test_payments_keep_the_least_flag_without_a_sort(spark, tmp_path):
    now = dt.datetime(2001, 1, 1)
    flags = [["N"], ["R"], ["A"], ["R", "N"], ["N", "A"], ["R", "P"], ["Z", "R"], ["Z"], [None], [None, "R"], ["", "N"]]
    lines = [(k, 1, 1.5, now, f) for k, some in enumerate(flags) for f in some]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp_ntz, l_returnflag string"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    pays = Tables(spark, str(tmp_path), stored=False).payments
    status = {"N": "Completed", "R": "Refunded"}
    want = {k: status.get(min((f for f in some if f is not None), default=None), "Failed") for k, some in enumerate(flags)}
    assert {r["subscription_id"]: r["status"] for r in pays.collect()} == want
    assert "SortAggregate" not in plan(pays)


def test_stored_tables_are_arranged_before_texts_are_made(spark):
    t = Tables(spark, SF001)
    for name, texts in (("outbox", {"payload"}), ("webhook_inbound", {"raw_payload"}), ("logs", {"message"}), ("payments", {"transaction_id"})):
        seen = []
        df = getattr(t, f"_map_{name}")(lambda rows, *order: seen.extend(rows.columns) or rows)
        assert seen and texts <= set(df.columns) and not texts & set(seen)


def test_positions_are_read_by_column(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("o"), F.repeat(F.lit("x"), 50).alias("note"))
    rows = ids.positions(df, ["o"], "_at")
    assert rows.where(F.col("o") != F.col("_at")).count() == 0 and rows.count() == 1000
    assert "note" not in plan(rows.select("o", "_at"))


def test_webhooks_find_payments_by_either_key(spark):
    now = dt.datetime(2001, 1, 1)
    pays = spark.createDataFrame([(1, "TXN-1"), (2, "TXN-2"), (3, None), (4, "4")], "payment_id long, transaction_id string")
    bodies = ['{"type":"a","transactionId":"TXN-2","status":"Failed"}', '{"type":"a","paymentId":3,"status":"Refunded"}',
              '{"type":"a","transactionId":"4","paymentId":1}', '{"type":"a","paymentId":9}', '{"type":"a"}', '{"type":"a","paymentId":3}']
    w = spark.createDataFrame([(i, f"e{i}", b, now, "c") for i, b in enumerate(bodies)],
                              "seq long, event_id string, raw_payload string, received_at timestamp_ntz, client_key string")
    w = w.withColumn("signature", hmac_sha256_base64(F.col("raw_payload"), KEY))
    res = W.ingest(w, pays, spark.createDataFrame([], S.OUTBOX), KEY, with_outbox=False)
    assert {r["seq"]: r["target_payment_id"] for r in res["dispositions"].collect()} == {0: 2, 1: 3, 2: 4, 3: None, 4: None, 5: 3}
    assert {r["payment_id"]: (r["status"], r["seq"]) for r in res["payment_updates"].collect()} == {2: ("Failed", 0), 3: ("Completed", 5), 4: ("Completed", 2)}
    assert "Generate explode" not in plan(res["payment_updates"])  # payments under both keys
    none = W.ingest(w.where("seq = 4"), pays, spark.createDataFrame([], S.OUTBOX), KEY, with_outbox=False)
    assert none["payment_updates"].count() == 0 and none["dispositions"].count() == 1


def test_cancelled_subscriptions_do_not_wait_for_payments(spark):
    t = Tables(spark, SF001)
    r = SUB.cancel(t.subscriptions, t.plans, t.payments, C.cancels(t), AS_OF)
    for df in (r.upserts["subscriptions"], r.logs, r.notifications):
        assert "payment_id" not in plan(df)
    assert "payment_id" in plan(r.outcome)


def test_landed_rows_make_a_bounded_number_of_batches(spark):
    many = land(spark.range(1000).select(F.col("id").alias("o")), "many", "o", rows_per_file=50)
    assert len(spark.read.parquet(many).inputFiles()) == 20 and files_a_batch(spark, many) == 3
    few = land(spark.range(100).select(F.col("id").alias("o")), "few", "o")
    assert files_a_batch(spark, few) == 1


def test_a_union_of_joins_meets_other_rows(spark, tmp_path):
    """Names handed on within a batch, where no join is broadcast and AQE merges partitions by size."""
    n = 3000
    columns = [F.col("id").alias("plan_id"), F.concat(F.lit("name "), F.col("id")).alias("name"), *[F.lit("d").alias(c) for c in PL._VALUES]]
    spark.range(n).select(*columns, F.current_timestamp().alias("created_at")).write.parquet(f"{tmp_path}/plans")
    t = SimpleNamespace(plans=spark.read.parquet(f"{tmp_path}/plans"))
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "200b"}
    was = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        out = PL.update(t.plans, C.plan_renames(t), AS_OF).outcome.collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # every tenth row asks for a name that is not free yet, keeps its own, and its follower cannot take that
    want = {2 * i: (i, i % 10 != 3 or i == n - 1) for i in range(n)}
    want |= {2 * i + 1: (i, i % 10 != 4) for i in range(1, n) if i % 10 != 3}
    assert {r["seq"]: (r["plan_id"], r["accepted"]) for r in out} == want and len(out) == len(want)
