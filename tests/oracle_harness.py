"""Side-by-side check of a registered Spark query against its DuckDB oracle.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]

Mirrors the driver's gate: same column names, same row count, and an
order-insensitive comparison of the values (floats compared exactly and,
separately, to 9 significant digits so near-misses are visible).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"SET TimeZone='{os.environ.get('ORACLE_TZ', 'UTC')}'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if digits:
            return float(f"{v:.{digits}g}")
        return v
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def _rows(df: pd.DataFrame, digits=None):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x, digits) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def _spark_rows(sdf):
    rows = [r.asDict(recursive=True) for r in sdf.collect()]
    return pd.DataFrame(rows, columns=sdf.columns, dtype=object)


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from __spark_entry__ import oracle_sql, queries
    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    got = _spark_rows(sdf)
    t1 = time.time()
    sql = oracle_sql().get(name)
    res = {"name": name, "spark_rows": len(got), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    want = con.execute(sql).df().astype(object).where(lambda d: d.notna(), None)
    res["oracle_rows"] = len(want)
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    if gc != wc:
        res["status"] = f"COLUMNS {gc} vs {wc}"
        return res
    if gr == wr:
        res["status"] = "ok"
        return res
    _, gr9 = _rows(got, 9)
    _, wr9 = _rows(want, 9)
    res["status"] = "ok~9digits" if gr9 == wr9 else "MISMATCH"
    if res["status"] == "MISMATCH":
        diff = [(a, b) for a, b in zip(gr9, wr9) if a != b][:3]
        res["first_diffs"] = diff
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from haze.session import get_spark
    from __spark_entry__ import queries
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    for name in names or list(queries()):
        try:
            r = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        print(r, flush=True)


if __name__ == "__main__":
    main(sys.argv)
