"""Run every registered query in Spark and its oracle in DuckDB; compare order-insensitively.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from cargoscope.session import build_session, ensure_checkpoint_dir  # noqa: E402
from cargoscope.sources.tables import TABLE_NAMES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)  # exact: both engines must produce the same double, bit for bit
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def digest(rows):
    lines = sorted("|".join(str(norm(x)) for x in r) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    extra = dict(kv.split("=", 1) for kv in os.environ.get("ORACLE_SPARK_CONF", "").split(",") if kv)
    spark = build_session(extra=extra)
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="ckpt-", dir="/tmp"))
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = []
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = sorted(df.columns)
            srows = [tuple(r[c] for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad.append(name)
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            rel = con.execute(sqls[name])
            dcols = [d[0] for d in rel.description]
            drows_raw = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad.append(name)
            continue
        if sorted(dcols) != cols:
            print(f"FAIL {name}: columns spark={cols} duck={sorted(dcols)}")
            bad.append(name)
            continue
        idx = [dcols.index(c) for c in cols]
        drows = [tuple(r[i] for i in idx) for r in drows_raw]
        hs, ls = digest(srows)
        hd, ld = digest(drows)
        if len(srows) != len(drows) or hs != hd:
            diff_s = sorted(set(ls) - set(ld))[:3]
            diff_d = sorted(set(ld) - set(ls))[:3]
            print(f"FAIL {name}: rows spark={len(srows)} duck={len(drows)}\n  spark-only {diff_s}\n  duck-only {diff_d}")
            bad.append(name)
        else:
            print(f"OK   {name}: {len(srows)} rows {ts:.2f}s")
    print("BAD:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
