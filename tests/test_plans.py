"""Plan checks: no Python evaluation or Cartesian products in batch
queries, filters reach the Parquet scan, projections are pruned."""

import pytest

from subsight.plans.catalog import all_queries

from .conftest import SF001

QUERIES = all_queries()
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_cartesian(spark, name):
    plan = _plan(QUERIES[name].run(spark, SF001))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SortAggregate" not in plan  # every aggregate is a (partial) hash aggregate


def test_filter_pushed_to_scan(spark):
    from subsight.operators import reports as R
    from subsight.sources.tables import Tables
    for stored in (True, False):
        t = Tables(spark, SF001, stored=stored)
        df = R.expired_by_plan(t.subscriptions, t.plans, "2001-08-15 00:00:00")
        plan = _plan(df)
        assert "PushedFilters: [Or(EqualTo(status,Expired)" in plan or "o_orderdate" in plan


def test_scan_prunes_columns(spark):
    from subsight.sources.tables import Tables
    t = Tables(spark, SF001, stored=False)
    plan = _plan(t.payments.select("payment_id", "status"))
    assert "l_extendedprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def _run_plan(spark, name):
    df = QUERIES[name].run(spark, SF001)
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return _plan(df)


def test_latest_payment_is_a_partial_aggregate(spark):
    plan = _run_plan(spark, "latest_completed_payment")
    assert "Window" not in plan and "partial_max" in plan


def test_webhook_first_wins_without_window(spark):
    from subsight.operators import webhooks as W
    from subsight.plans.registry import HMAC_TEST_KEY
    from subsight.sources.tables import Tables
    t = Tables(spark, SF001)
    d = W.dispositions(W.signed_inbound(t, HMAC_TEST_KEY), HMAC_TEST_KEY)
    d.write.format("noop").mode("overwrite").save()
    plan = _plan(d)
    assert "Window" not in plan and "partial_min" in plan


def test_rate_limit_partial_top_k(spark):
    plan = _run_plan(spark, "rate_limit_admit")
    # a partial top-k runs before the shuffle: at most k rows per group leave a map task
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_first_k_salts_beyond_the_partial_limit(spark):
    from pyspark.sql import functions as F

    from subsight.operators import ratelimit as RL
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("seq"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        out = RL.first_k(df, ["g"], ["seq"], 30, "seq")
        out.write.format("noop").mode("overwrite").save()
        assert "xxhash64" in _plan(out)
        got = {r["g"]: r["n"] for r in out.where("admitted").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == {0: 30, 1: 30, 2: 30}
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_reports_aggregate_before_join(spark):
    plan = _run_plan(spark, "plan_metrics")
    # the partial aggregate sits below the join with plan names
    assert plan.index("Join") < plan.index("partial_count")


def test_quality_row_rules_one_scan_per_table(spark):
    plan = _run_plan(spark, "dq_required")
    # six tables carry row rules (the outbox too); each is read once
    assert plan.count("FileScan parquet") == 6


def test_stored_tables_equal_direct_mapping(spark):
    from subsight.sources.tables import Tables
    stored, direct = Tables(spark, SF001), Tables(spark, SF001, stored=False)
    for name in Tables.TABLES:
        a, b = getattr(stored, name), getattr(direct, name)
        assert a.columns == b.columns
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_saved_tables_read_back(spark):
    from subsight.operators import reports as R
    from subsight.session import scratch_path
    from subsight.sources.tables import StoredTables, Tables
    t = Tables(spark, SF001)
    folder = t.save(scratch_path(spark, "saved"))
    st = StoredTables(spark, folder)
    a = R.plan_metrics(st.subscriptions, st.plans).collect()
    b = R.plan_metrics(t.subscriptions, t.plans).collect()
    assert a == b and len(a) > 0
    assert [f.name for f in st.payments.schema.fields] == t.payments.columns
    assert "signature" in StoredTables(spark, folder).webhook_inbound.columns


def test_materialize_runs_jobs_concurrently_and_once(spark):
    from subsight.sources import tables as TB
    t = TB.Tables(spark, SF001).materialize(threads=4)
    key = (spark.sparkContext.applicationId, SF001.rstrip("/"), "payments")
    path = TB._STORED[key]
    # a second handle reuses the stored copy instead of writing again
    folder = path.rstrip("/").rsplit("/", 1)[-1]
    assert all(f"/{folder}/" in f for f in TB.Tables(spark, SF001).payments.inputFiles())
    assert t.payments.count() == TB.Tables(spark, SF001, stored=False).payments.count()


@pytest.mark.parametrize("name,column", [("revenue", "payment_date"), ("subscriptions_page", "start_date"),
                                         ("filter_payments_range", "payment_date")])
def test_date_ranges_reach_the_scan(spark, name, column):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        QUERIES[name].run(spark, SF001).explain("formatted")
    pushed = [line for line in buf.getvalue().split("\n") if "PushedFilters" in line]
    assert any(f"GreaterThanOrEqual({column}" in line and f"LessThan({column}" in line for line in pushed), pushed


def test_stored_tables_reject_unknown_names(spark):
    from subsight.sources.tables import StoredTables
    with pytest.raises(AttributeError):
        StoredTables(spark, "/nowhere").not_a_table  # noqa: B018


def test_checkpoint_dir_comes_from_the_session(spark):
    from subsight.session import checkpoint_dir
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() == d
