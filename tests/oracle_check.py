"""Compare every registered Spark query with its DuckDB oracle.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query and a summary; exit code 1 on any mismatch.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


STRICT = os.environ.get("ORACLE_STRICT") == "1"


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v if STRICT else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm_value(x)) for k, x in v.items()))
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(norm_value(r[i]) for i in order) for r in rows), key=repr)
    return cols, out


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    from netweave.session import build_session
    spark = build_session("local[8]")
    con = duck_connect(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        t1 = time.time()
        if name not in oracle:
            print(f"ROWS  {name}: {len(s_rows)} rows ({t1 - t0:.1f}s, no oracle)")
            continue
        try:
            res = con.execute(oracle[name])
            d_cols = [d[0] for d in res.description]
            d_rows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            continue
        sc, sr = canon(s_cols, s_rows)
        dc, dr = canon(d_cols, d_rows)
        if sc != dc:
            bad += 1
            print(f"FAIL  {name}: columns differ\n   spark {sc}\n   duck  {dc}")
        elif sr != dr:
            bad += 1
            missing = [r for r in dr if r not in set(sr)][:3]
            extra = [r for r in sr if r not in set(dr)][:3]
            print(f"FAIL  {name}: rows differ spark={len(sr)} duck={len(dr)}\n"
                  f"   only duck {missing}\n   only spark {extra}")
        else:
            print(f"OK    {name}: {len(sr)} rows ({t1 - t0:.1f}s)")
    print(f"{'ALL OK' if not bad else f'{bad} FAILED'} of {len(qs) if not only else len(only)}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
