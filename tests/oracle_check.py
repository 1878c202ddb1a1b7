"""Run registered queries and their SQL side by side and compare whole results.

Usage: python tests/oracle_check.py [sf] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def compare(spark_df, con, sql: str) -> str:
    names = sorted(spark_df.columns)
    t0 = time.time()
    ours = [tuple(_norm(r[n]) for n in names) for r in spark_df.select(*[f"`{n}`" for n in names]).collect()]
    t1 = time.time()
    rel = con.sql(sql)
    theirs_names = rel.columns
    if sorted(theirs_names) != names:
        return f"columns differ: {names} vs {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = [tuple(_norm(r[i]) for i in at) for r in rel.fetchall()]
    t2 = time.time()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    ours.sort(key=key)
    theirs.sort(key=key)
    if len(ours) != len(theirs):
        return f"rows differ: {len(ours)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        return f"{len(bad)} of {len(ours)} rows differ, first: {diff[:4]} in {a[:6]}"
    return f"ok {len(ours)} rows, collect {t1 - t0:.1f}s, sql {t2 - t1:.1f}s" if ours else "EMPTY"


def main() -> int:
    from stratapanel.plans.catalog import ORACLES, QUERIES
    from stratapanel.runtime import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    names = args[1:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            result = compare(df, con, ORACLES[name]) if name in ORACLES else f"rows only {df.count()}"
        except Exception as e:  # report and go on with the next query
            result = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        good = result.startswith(("ok", "rows only"))
        failed += not good
        print(f"{'PASS' if good else 'FAIL'} {name} [{time.time() - start:.1f}s] {result}", flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
