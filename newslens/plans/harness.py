"""Local parity check: run a registered query in Spark and its oracle in DuckDB
on the same parquet tables, then compare columns, row count and an
order-insensitive multiset of rows."""

from __future__ import annotations

import math
import os
import time
from collections import Counter

from newslens.sources.tables import TABLES


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
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def compare(spark, name: str, sf_dir: str, fn, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    rows = sdf.collect()
    t_spark = time.time() - t0
    cols = sdf.columns
    out = {"query": name, "rows": len(rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out["oracle_rows"] = len(drows)
    if sorted(cols) != sorted(dcols):
        out["status"] = f"COLUMNS spark={sorted(cols)} duck={sorted(dcols)}"
        return out
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    a = Counter(tuple(_norm(r[i]) for i in si) for r in rows)
    b = Counter(tuple(_norm(r[i]) for i in di) for r in drows)
    if a == b:
        out["status"] = "match"
    else:
        only_a = list((a - b).elements())[:3]
        only_b = list((b - a).elements())[:3]
        out["status"] = f"MISMATCH spark-only={only_a} duck-only={only_b}"
    return out
