"""The command line runs against the shared session."""

import os

from subsight.__main__ import main
from subsight.session import scratch_path

from .conftest import SF001


def test_list_and_sql(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "plan_metrics" in out and "mixed_subscription_batch" in out
    assert main(["sql", "revenue"]) == 0
    assert "SUM(amount)" in capsys.readouterr().out


def test_apply_publishes_snapshot(spark, capsys):
    out = scratch_path(spark, "cli-apply")
    assert main(["apply", "expire", "--sf-dir", SF001, "--out", out]) == 0
    assert os.path.exists(os.path.join(out.replace("file:", ""), "_PUBLISHED"))
    assert spark.read.parquet(f"{out}/upserts/subscriptions").where("status <> 'Expired'").count() == 0


def test_run_writes_result(spark):
    out = scratch_path(spark, "cli-run")
    assert main(["run", "churn_rate", "--sf-dir", SF001, "--out", out, "--format", "json"]) == 0
    assert spark.read.json(out).count() == 1
