"""Run registered queries against their DuckDB oracle (the driver's check, locally).

    python tests/oracle_check.py [sf_dir] [key ...]

Prints one line per key: row counts, column names and an order-insensitive
value hash on both sides.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), [cols[i] for i in order]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    from staytrail.session import get_session
    spark = get_session("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if only and k not in only:
            continue
        t = time.time()
        try:
            sdf = fn(spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t
        if k not in sqls:
            print(f"ROWS {k}: spark {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[k])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        sh, sc = digest(scols, srows)
        dh, dc = digest(dcols, drows)
        ok = len(srows) == len(drows) and sc == dc and sh == dh
        bad += not ok
        print(f"{'OK  ' if ok else 'DIFF'} {k}: rows {len(srows)}/{len(drows)} cols {'=' if sc == dc else (sc, dc)} "
              f"hash {'=' if sh == dh else 'differs'} ({ts:.1f}s)")
        if not ok and sc == dc and len(srows) == len(drows):
            order = sorted(range(len(scols)), key=lambda i: scols[i])
            a = sorted("|".join(norm(r[i]) for i in order) for r in srows)
            order = sorted(range(len(dcols)), key=lambda i: dcols[i])
            b = sorted("|".join(norm(r[i]) for i in order) for r in drows)
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            for x, y in diffs:
                print("   spark:", x[:300])
                print("   duck :", y[:300])
    print(f"done: {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
