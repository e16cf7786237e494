"""Named views and SQL functions; deep pages by position; landing in exact chunks."""

import pytest
from pyspark.sql import functions as F

from subsight.operators import listing as L
from subsight.operators import named as N
from subsight.operators import views as V
from subsight.plans.catalog import all_queries
from subsight.session import scratch_path
from subsight.sources.tables import Tables
from subsight.streaming.landing import land

from .conftest import SF001
from .oracle_check import compare, duck

QUERIES = ["sql_active_subscriptions", "sql_payment_history_by_plan", "sql_revenue", "sql_is_subscription_active",
           "plans_page_deep", "users_page_deep", "subscriptions_page_deep"]


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF001)


@pytest.mark.parametrize("name", QUERIES)
def test_queries_equal_their_sql(spark, name):
    problems, _ = compare(spark, name, all_queries()[name], SF001, duck(SF001))
    assert problems == []


def test_views_are_the_operators(spark, t):
    N.register(spark, t)
    N.register(spark, t)  # again: replaced
    a, b = spark.table("vw_active_subscriptions"), V.active_subscriptions(t.subscriptions, t.users, t.plans)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


def test_view_filters_reach_the_scan(spark, t):
    N.register(spark, t)
    df = spark.sql("SELECT subscription_id FROM vw_active_subscriptions WHERE end_date > TIMESTAMP_NTZ '2001-08-15'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(end_date" in plan and "auto_renew" not in plan


def test_function_of_a_column_is_a_join(spark, t):
    N.register(spark, t)
    df = spark.sql("SELECT subscription_id, is_subscription_active(subscription_id, TIMESTAMP_NTZ '2001-08-15') AS a FROM subscriptions")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_revenue_range_reaches_the_scan(spark, t):
    N.register(spark, t)
    df = spark.sql(N.REVENUE, {"date_from": "2000-01-01", "date_to": "2000-12-31"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(paymen" in plan and "NestedLoop" not in plan  # the plan's text cuts long filters off
    assert df.first()[0] == spark.sql("SELECT calculate_revenue(TIMESTAMP_NTZ '2000-01-01', TIMESTAMP_NTZ '2000-12-31')").first()[0] > 0


def test_revenue_of_nothing_and_of_the_last_day(spark):
    import datetime as dt
    from types import SimpleNamespace

    from subsight.sources import schemas as S
    row = lambda i, day, status, amount: (i, 1, amount, day, None, f"t{i}", status)
    from decimal import Decimal as D
    pay = [row(1, dt.datetime(2000, 1, 2, 23, 59, 59), "Completed", D("5.00")), row(2, dt.datetime(2000, 1, 3), "Completed", D("7.00")),
           row(3, dt.datetime(2000, 1, 1), "Failed", D("9.00")), row(4, dt.datetime(2000, 1, 1), "Completed", D("1.50"))]
    empty = lambda s: spark.createDataFrame([], s)
    N.register(spark, SimpleNamespace(payments=spark.createDataFrame(pay, S.PAYMENTS), plans=empty(S.PLANS), users=empty(S.USERS),
                                      subscriptions=empty(S.SUBSCRIPTIONS)))
    got = spark.sql("""SELECT calculate_revenue(TIMESTAMP_NTZ '2000-01-01', TIMESTAMP_NTZ '2000-01-02') AS a,
                              calculate_revenue(TIMESTAMP_NTZ '2010-01-01', TIMESTAMP_NTZ '2010-01-02') AS b,
                              is_subscription_active(1, TIMESTAMP_NTZ '2000-01-01') AS c""").first()
    assert tuple(got) == (D("6.50"), D("0.00"), False)


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_by_position_equal_pages_by_offset(spark, direction):
    df = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 10).alias("v"))
    first = L.PageRequest(1, 40, "v", direction)
    index = L.position_index(df, "v", "k", first, scratch_path(spark, "index"))
    for page in (1, 2, 12, 13, 14):
        req = L.PageRequest(page, 40, "v", direction)
        assert [tuple(r)[:2] for r in L.page_at(index, req).select("k", "v").collect()] == [tuple(r) for r in L.page(df, "v", "k", req).collect()]


def test_deep_page_reads_its_positions(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10).alias("v"))
    req = L.PageRequest(20, 25, "v", "asc")
    page = L.page_at(L.position_index(df, "v", "k", req, scratch_path(spark, "index")), req)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(position,475)" in plan and "LessThan(position,500)" in plan


def test_landing_splits_equal_order_values(spark):
    df = spark.range(1000).select(F.lit(5).alias("o"), F.col("id").alias("x"))
    path = land(df, "ties", "o", rows_per_file=100)
    sizes = [r["n"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100
    assert land(df.limit(0), "none", "o")


def test_landing_keeps_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("o"))
    path = land(df, "order", "o", chunks=7)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_modification_time").alias("t")).agg(
        F.min("o").alias("a"), F.max("o").alias("z")).orderBy("t").collect()
    assert len(files) == 7 and all(x["z"] < y["a"] for x, y in zip(files, files[1:]))
