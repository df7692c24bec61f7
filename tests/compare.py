"""Spark-vs-DuckDB comparison in the shape of the correctness gate:
row count, column names, and an order-insensitive value comparison.

Usage: python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool):
        return v
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, int):
        return float(v)
    try:
        from decimal import Decimal
        if isinstance(v, Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return str([_norm(x) for x in (v.tolist() if hasattr(v, "tolist") else v)])
    return str(v)


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records")]
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    import __spark_entry__ as E
    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir).toPandas()
    ts = time.time() - t0
    res = {"name": name, "spark_rows": len(sdf), "spark_sec": round(ts, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    t0 = time.time()
    odf = con.execute(sql).fetchdf()
    res["oracle_sec"] = round(time.time() - t0, 2)
    res["oracle_rows"] = len(odf)
    if sorted(sdf.columns) != sorted(odf.columns):
        res["status"] = "schema"
        res["detail"] = (sorted(set(sdf.columns) - set(odf.columns)), sorted(set(odf.columns) - set(sdf.columns)))
        return res
    a, b = frame_rows(sdf), frame_rows(odf)
    if len(a) != len(b):
        res["status"] = "rowcount"
        return res
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        res["status"] = "values"
        cols = sorted(sdf.columns)
        x, y = bad[0]
        res["detail"] = [(cols[i], x[i], y[i]) for i in range(len(cols)) if x[i] != y[i]][:8]
        res["n_bad"] = len(bad)
    else:
        res["status"] = "match"
    return res


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from quire.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    names = names or list(E.queries())
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # keep going, report
            r = {"name": n, "status": "error", "detail": str(e)[:400]}
        print(r, flush=True)


if __name__ == "__main__":
    main(sys.argv)
