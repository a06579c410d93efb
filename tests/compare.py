"""Run a Spark operator and its DuckDB oracle on the same parquet tables and compare.

Usage: python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return v.date() if hasattr(v, "date") else v
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for _, r in df.iterrows()]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                            for x in r))


def compare(spark, con, sf_dir: str, name: str, query, sql: str, exact: bool = True) -> str | None:
    """Return None when equal, else a short description of the first difference."""
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns differ: {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"row count {len(got)} vs {len(want)}"
    a, b = _rows(got), _rows(want)
    cols = sorted(got.columns)
    for ra, rb in zip(a, b):
        for c, x, y in zip(cols, ra, rb):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float) and not exact and \
                    math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12):
                continue
            return f"value differs in {c}: {x!r} vs {y!r} (row {ra} vs {rb})"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from salesgrid.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(E.oracle_sql())
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    q, s = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        try:
            err = compare(spark, con, sf_dir, n, q[n], s[n])
        except Exception as exc:  # report and continue
            err = f"error: {type(exc).__name__}: {str(exc)[:400]}"
        print(f"{'OK  ' if err is None else 'FAIL'} {n}" + ("" if err is None else f"  {err}"),
              flush=True)
        bad += err is not None
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
