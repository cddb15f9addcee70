"""Compares a Spark result with a DuckDB query over the same Parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def table_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is not None, x or "") for x in r))


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert table_of([tuple(r) for r in df.collect()], df.columns) == table_of(want.fetchall(), names)
