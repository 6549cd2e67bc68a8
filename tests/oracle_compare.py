"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Prints one line per query: name, rows spark/duckdb, columns equal, values equal.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    st = time.time() - t
    if sql is None:
        return f"{name:28s} spark={len(srows):7d} (rows-only) {st:6.1f}s"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    same_cols = sorted(scols) == sorted(dcols)
    same_vals = same_cols and canon(srows, scols) == canon(drows, dcols)
    msg = f"{name:28s} spark={len(srows):7d} duck={len(drows):7d} cols={same_cols} vals={same_vals} {st:6.1f}s"
    if not same_cols:
        msg += f"\n    spark cols {scols}\n    duck  cols {dcols}"
    elif not same_vals:
        a, b = canon(srows, scols), canon(drows, dcols)
        sa, sb = set(a), set(b)
        msg += f"\n    only spark: {list(sa - sb)[:3]}\n    only duck:  {list(sb - sa)[:3]}"
    return msg


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    import __spark_entry__ as E
    from logmold.session import get_session

    spark = get_session(f"local[{os.environ.get('CPUS', 8)}]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            print(compare(spark, con, name, fn, sqls.get(name), sf_dir), flush=True)
        except Exception as e:  # report and continue
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)


if __name__ == "__main__":
    main()
