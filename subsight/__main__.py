"""Command line: list, run, explain or export any registered query.

    python -m subsight list
    python -m subsight run plan_metrics --sf-dir /root/testdata/sf0.01 --show 20
    python -m subsight run cancel_batch --sf-dir DIR --out /shared/out/cancel --format parquet
    python -m subsight explain user_360 --sf-dir DIR
    python -m subsight sql plan_metrics          # the DuckDB oracle statement
    python -m subsight apply cancel --sf-dir DIR --commands /shared/in/cancels --out /shared/snap/0001

With spark-submit the master comes from the cluster; locally use --master.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="subsight")
    ap.add_argument("command", choices=["list", "run", "explain", "sql", "apply"])
    ap.add_argument("name", nargs="?")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--master", default=None)
    ap.add_argument("--out", default=None, help="write the result here instead of showing it")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    ap.add_argument("--show", type=int, default=20)
    ap.add_argument("--commands", default=None, help="Parquet folder of commands for 'apply' (default: derived)")
    ap.add_argument("--as-of", default=None, help="as_of for 'apply' (default: the registered as_of)")
    a = ap.parse_args(argv)

    if a.command == "apply":
        return _apply(a)

    from .plans.catalog import all_queries

    qs = all_queries()
    if a.command == "list":
        for name, q in sorted(qs.items()):
            print(f"{name:32s} {(q.doc or '').strip().splitlines()[0] if q.doc else ''}")
        return 0
    if a.name not in qs:
        print(f"unknown query {a.name!r}; see 'python -m subsight list'", file=sys.stderr)
        return 2
    if a.command == "sql":
        print(qs[a.name].sql or "-- no oracle SQL")
        return 0

    from .session import build_session

    spark = build_session(a.master)
    df = qs[a.name].run(spark, a.sf_dir)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        w = df.write.mode("errorifexists")
        if a.format == "csv":
            w = w.option("header", True)
        getattr(w, a.format)(a.out)
    else:
        df.show(a.show, truncate=False)
    return 0


def _jobs():
    from .operators import payment_jobs as PJ
    from .operators import plan_jobs as PL
    from .operators import subscription_jobs as SJ
    from .operators import user_jobs as UJ
    from .sources import commands as C

    # job -> (run(tables, commands, as_of), derived commands)
    return {
        "subscribe": (lambda t, c, d: SJ.subscribe(t.users, t.plans, t.subscriptions, t.payments, c, d), C.subscribes),
        "renew": (lambda t, c, d: SJ.renew(t.subscriptions, t.plans, t.payments, c, d), C.renewals),
        "cancel": (lambda t, c, d: SJ.cancel(t.subscriptions, t.plans, t.payments, c, d), C.cancels),
        "mixed": (lambda t, c, d: SJ.mixed(t.subscriptions, t.plans, t.payments, c, d), C.mixed_commands),
        "set_status": (lambda t, c, d: SJ.set_status(t.subscriptions, c), C.status_changes),
        "expire": (lambda t, c, d: SJ.expire_due(t.subscriptions, d), None),
        "record_payments": (lambda t, c, d: PJ.record_payments(t.subscriptions, t.payments, t.outbox, c, d), C.payment_records),
        "refund": (lambda t, c, d: PJ.refund(t.payments, t.subscriptions, t.plans, c, d), C.refunds),
        "upsert_plans": (lambda t, c, d: PL.upsert(t.plans, c, d), C.plan_upserts),
        "update_plans": (lambda t, c, d: PL.update(t.plans, c, d), C.plan_updates),
        "delete_plans": (lambda t, c, d: PL.delete(t.plans, t.subscriptions, c, d), C.plan_deletes),
        "register_users": (lambda t, c, d: UJ.register(t.users, c, d), C.bulk_users),
        "update_users": (lambda t, c, d: UJ.update(t.users, c, d), C.user_updates),
        "delete_users": (lambda t, c, d: UJ.delete(t.users, t.subscriptions, c, d), C.user_deletes),
    }


def _apply(a) -> int:
    """Run one change job and publish every output under --out (marker last)."""
    jobs = _jobs()
    if a.name not in jobs or not a.out:
        print(f"usage: apply <{'|'.join(jobs)}> --out FOLDER [--commands PARQUET]", file=sys.stderr)
        return 2
    from .plans.registry import AS_OF
    from .session import build_session
    from .sources.sinks import publish
    from .sources.tables import Tables

    spark = build_session(a.master)
    t = Tables(spark, a.sf_dir)
    run, derive = jobs[a.name]
    cmds = spark.read.parquet(a.commands) if a.commands else (derive(t) if derive else None)
    out = publish(run(t, cmds, a.as_of or AS_OF), a.out)
    for k, v in out.items():
        print(f"{k:28s} {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
