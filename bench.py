"""Benchmark of the headline queries.

Maps the driver's files to the seven tables once (stored in the shared
checkpoint folder, timed as ``materialize_tables``), then runs each query to
completion with the ``noop`` sink (every row computed, nothing collected to
the driver) at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line
(with $BENCH_EVENT_LOG set, Spark's event log goes to that folder):
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "plan_metrics", "revenue", "churn_rate", "avg_duration_days", "expired_by_plan", "admin_kpis",
    "active_subscriptions", "user_payment_history", "user_360", "latest_completed_payment",
    "subscriptions_page", "payments_page", "page_totals", "quality_violations",
    "subscribe_batch", "renew_batch", "cancel_batch", "refund_batch", "expire_due", "mixed_subscription_batch",
    "webhook_ingest", "outbox_dispatch", "rate_limit_admit",
    "payments_page_after", "stream_logs", "stream_notifications", "stream_outbox", "stream_webhooks", "stream_rate_limit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from subsight.plans.catalog import all_queries
    from subsight.session import build_session

    extra = {"spark.driver.memory": "16g"}
    log_dir = os.environ.get("BENCH_EVENT_LOG")  # stage/task times, read from the file afterwards
    if log_dir:
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    spark = build_session(f"local[{cpus}]", app="subsight-bench", shuffle_partitions=max(8, 2 * cpus), extra=extra)
    from subsight.sources.tables import Tables

    qs = all_queries()
    times: dict[str, float] = {}
    # The mapping from the driver's files to the seven tables runs once and is
    # stored (as a deployment stores its tables); its time counts in the total.
    t0 = time.perf_counter()
    Tables(spark, sf_dir).materialize()
    times["materialize_tables"] = round(time.perf_counter() - t0, 3)
    qs["churn_rate"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in names:
        t0 = time.perf_counter()
        qs[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
