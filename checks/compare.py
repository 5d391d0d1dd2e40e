"""Run registered queries next to their SQL in DuckDB and compare the results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def check(spark, sf: str, names=None) -> int:
    from checks.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    for name, query in QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            rows = [tuple(r) for r in df.collect()]
        except Exception as problem:
            print(f"FAIL {name}: {str(problem)[:600]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows {name}: {len(rows)} rows {took:.1f}s")
            continue
        try:
            cur = con.execute(ORACLES[name])
            want_cols = [d[0] for d in cur.description]
            want = cur.fetchall()
        except Exception as problem:
            print(f"FAIL {name} (sql): {str(problem)[:600]}")
            bad += 1
            continue
        a, b = _rows(df.columns, rows), _rows(want_cols, want)
        if a == b:
            print(f"ok   {name}: {len(rows)} rows {took:.1f}s")
            continue
        bad += 1
        print(f"DIFF {name}: {len(rows)} vs {len(want)} rows; columns {a[0]} vs {b[0]}")
        sa, sb = set(a[1]), set(b[1])
        for label, left in (("spark", sa - sb), ("sql", sb - sa)):
            for r in sorted(left)[:3]:
                print("   ", label, str(r)[:700])
    return bad


if __name__ == "__main__":
    from webrisk.session import local_session

    sys.exit(check(local_session(), "/root/testdata/sf0.01", sys.argv[1:]))
