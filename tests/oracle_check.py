"""Side-by-side check of a registered query against its DuckDB oracle,
the same way the driver compares them: row count, column names and an
order-insensitive comparison of values (columns sorted by name).

Run as a script: ``python -m tests.oracle_check [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
          "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "nan"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name, q, sf_dir, con=None):
    con = con or duck(sf_dir)
    df = q.run(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(q.sql)
    d_cols, d_types = rel.columns, [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    s_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c, t in zip(d_cols, d_types):
        want = _TYPES.get(t, t.lower())
        if s_types.get(c) != want:
            problems.append(f"type of {c}: spark={s_types.get(c)} duck={t}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_rows)


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    from subsight.plans.catalog import all_queries
    from subsight.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs = all_queries()
    bad = 0
    for name in names or sorted(qs):
        q = qs[name]
        if not q.sql:
            n = q.run(spark, sf_dir).count()
            print(f"{name:34s} rows-only {n}")
            continue
        try:
            problems, n = compare(spark, name, q, sf_dir, con)
        except Exception as e:  # report and go on
            problems, n = [f"error {type(e).__name__}: {str(e)[:400]}"], -1
        bad += bool(problems)
        print(f"{name:34s} {'OK ' if not problems else 'BAD'} {n} {'; '.join(problems)}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
