"""One subscription holds half of a large command set: its join partition is split in the final plan."""

import pytest
from pyspark.sql import functions as F

from subsight.operators import subscription_jobs as SJ
from subsight.sources.tables import Tables

from .conftest import SF001

AS_OF = "2001-08-15 00:00:00"
SMALL = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def small_partitions(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def commands(spark, t, kind=None):
    one = t.subscriptions.where("status = 'Active'").orderBy("subscription_id").first()
    every = t.subscriptions.select("subscription_id", "user_id").collect()
    n = 60_000
    ids = F.array(*[F.lit(r["subscription_id"]) for r in every])
    users = F.array(*[F.lit(r["user_id"]) for r in every])
    at = (F.xxhash64("id") % len(every) + len(every)) % len(every)
    hot = F.col("id") % 2 == 0
    return spark.range(n, numPartitions=8).select(
        F.col("id").alias("seq"),
        F.when(hot, F.lit(one["subscription_id"])).otherwise(F.get(ids, at.cast("int"))).alias("subscription_id"),
        F.when(hot, F.lit(one["user_id"])).otherwise(F.get(users, at.cast("int"))).alias("user_id"),
        F.lit("PayPal").alias("payment_method"), F.lit("Expired").alias("new_status"),
        F.when(F.col("id") % 3 == 0, "cancel").otherwise("renew").alias("kind"), F.repeat(F.lit("x"), 50).alias("note"))


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_set_status_splits_the_hot_join(spark, small_partitions):
    t = Tables(spark, SF001)
    assert "skew=true" in final_plan(SJ.set_status(t.subscriptions, commands(spark, t)).outcome)


def test_cancel_splits_the_hot_join(spark, small_partitions):
    t = Tables(spark, SF001)
    assert "skew=true" in final_plan(SJ.cancel(t.subscriptions, t.plans, t.payments, commands(spark, t), AS_OF).outcome)
