"""Compares a registered query with its SQL over the same tables: names, row count and values in any order.

Run as a script: python tests/parity.py [--sf DIR] NAME... (all without names).
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.9g}"))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if type(v).__name__ == "Decimal":
        return plain(float(v)) if v % 1 else int(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> str:
    """Empty if equal, else the first difference."""
    a_cols, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    b_cols, b = rows_of([d[0] for d in out.description], out.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} / {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, as {str(bad[0])[:1500]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from scriptorium.plans.session import local_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark, con = local_session(), duck(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or list(queries):
        began = time.time()
        try:
            df = queries[name](spark, sf)
            if name in sqls:
                said = compare(df, con, sqls[name]) or f"equal, {df.count()} rows"
            else:
                said = f"rows only: {len(df.collect())} {df.columns}"
        except Exception as e:
            said = f"ERROR {str(e)[:1200]}"
        failed += not said.startswith(("equal", "rows only"))
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print(f"{failed} failed")
    os._exit(failed > 0)
