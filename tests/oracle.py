"""Compare registered queries with their check SQL on DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{v!r}"
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return cell(v.asDict())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, entry, sf_dir):
    """(ok, message) for one registered query."""
    start = time.time()
    df = entry.run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if entry.sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL ({took:.1f}s)"
    start = time.time()
    cur = con.execute(entry.sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    note = f"{len(got)} rows ({took:.1f}s, sql {time.time() - start:.1f}s)"
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got == want:
        return len(got) > 0, note
    a, b = set(got), set(want)
    return False, (f"{note}, want {len(want)}\n  only spark: {[str(x)[:300] for x in sorted(a - b)[:3]]}"
                   f"\n  only sql:   {[str(x)[:300] for x in sorted(b - a)[:3]]}")


if __name__ == "__main__":
    from quarry.registry import CATALOG
    from quarry.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or CATALOG.names()
    spark, con = local_session("8"), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, message = compare(spark, con, CATALOG.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failures:", bad)
