"""Compare registered queries with their SQL checks in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from cardloom.sources.tables import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return True, f"{name}: rows={len(got)} {took:.1f}s (no sql)"
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(cols)}"
    def kind(v):
        return type(v).__name__
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        only_g = [r for r in got if r not in set(want)][:2] if len(got) < 5000 else []
        only_w = [r for r in want if r not in set(got)][:2] if len(want) < 5000 else []
        return False, (f"{name}: MISMATCH {len(got)} vs {len(want)} {sorted(cols)}\n   {diff}\n"
                       f"   spark-only {only_g}\n   sql-only {only_w}")
    kinds = [(kind(a), kind(b)) for a, b in zip(got[0], want[0])] if got else []
    if any(a != b for a, b in kinds):
        return False, f"{name}: TYPES {kinds} {sorted(cols)}"
    return True, f"{name}: ok rows={len(got)} {took:.1f}s"


if __name__ == "__main__":
    from cardloom.plans.session import local_session
    from cardloom.queries.registry import CHECKS, QUERIES
    import importlib
    folder = f"/root/testdata/sf{sys.argv[1]}"
    for fam in sys.argv[2].split(","):
        importlib.import_module(f"cardloom.queries.{fam}")
    only = sys.argv[3].split(",") if len(sys.argv) > 3 else None
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        try:
            ok, msg = compare(spark, con, name, fn, CHECKS.get(name), folder)
        except Exception as e:  # report and go on
            ok, msg = False, f"{name}: ERROR {type(e).__name__} {str(e)[:900]}"
        bad += not ok
        print(msg, flush=True)
    print("BAD", bad)
    spark.stop()
