"""Run registered Spark queries next to their DuckDB oracle SQL and compare.

Mirrors the correctness gate: same column names, same row count, and the same
multiset of rows (order-insensitive), with value types kept apart (1 != 1.0).

    python tests/oracle_harness.py [--sf-dir DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return ("n",)
    if isinstance(v, float) and math.isnan(v):
        return ("n",)
    if isinstance(v, (bool, np.bool_)):
        return ("b", bool(v))
    if isinstance(v, (int, np.integer)):
        return ("i", int(v))
    if isinstance(v, (float, np.floating)):
        return ("f", float(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return ("l", tuple(norm(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, norm(x)) for k, x in v.items())))
    return ("s", str(v))


def rows_of(records, cols):
    return Counter(tuple(norm(r[c]) for c in cols) for r in records)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    scols = sorted(sdf.columns)
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    dcols_raw = [d[0] for d in res.description]
    drows = [dict(zip(dcols_raw, r)) for r in res.fetchall()]
    t2 = time.time()
    out = {"name": name, "rows": len(srows), "oracle_rows": len(drows),
           "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if sorted(dcols_raw) != scols:
        out.update(ok=False, why=f"columns spark={scols} oracle={sorted(dcols_raw)}")
        return out
    a, b = rows_of(srows, scols), rows_of(drows, scols)
    if a == b:
        out["ok"] = True
    else:
        only_s = list((a - b).elements())[:3]
        only_d = list((b - a).elements())[:3]
        out.update(ok=False, why=f"spark-only {only_s} | oracle-only {only_d}")
    return out


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    import __spark_entry__ as E
    from rollspark.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    names = args.names or list(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], sqls.get(n), args.sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"checked {len(names)}, failed {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
