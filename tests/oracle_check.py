"""Run registered queries in Spark and their DuckDB oracles, compare results.

    python tests/oracle_check.py [sf_dir] [name ...]

Comparison: same column names, same row count, equal multiset of rows after
sorting columns by name (doubles compared to 1e-9 relative).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EXACT = os.environ.get("ORACLE_EXACT") == "1"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, v if EXACT else float(f"{v:.9g}"))
    if hasattr(v, "isoformat"):
        return (2, str(v).replace("T", " "))
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, (int,)):
        return (1, float(v))
    return (4, str(v))


def rows_of(records, cols):
    return sorted(tuple(_norm(r[c]) for c in cols) for r in records)


def compare(spark_df, con, sql):
    srows = [r.asDict(recursive=True) for r in spark_df.collect()]
    scols = sorted(spark_df.columns)
    res = con.execute(sql)
    dcols_raw = [d[0] for d in res.description]
    drows = [dict(zip(dcols_raw, r)) for r in res.fetchall()]
    dcols = sorted(dcols_raw)
    if scols != dcols:
        return False, f"columns differ: spark={scols} duck={dcols}"
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    a, b = rows_of(srows, scols), rows_of(drows, dcols)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first differing row:\n spark={x}\n duck ={y}"
    return True, f"{len(srows)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    import __spark_entry__ as E
    if os.environ.get("ORACLE_VANILLA") == "1":  # a default session, as the driver may use
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        from replaygate.session import build_session
        spark = build_session("local[8]")
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in oracle:
                ok, msg = compare(df, con, oracle[name])
            else:
                ok, msg = True, f"{df.count()} rows (no oracle)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:28s} {time.time() - t:6.1f}s  {msg}", flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
