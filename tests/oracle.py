"""Compare registered queries with their SQL, row by row."""

from __future__ import annotations

import math
from glob import glob
from pathlib import Path

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, query, sql) -> str:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows([c[0] for c in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows and {len(want[1])}"
    bad = [(a, b) for a, b in zip(*(x[1] for x in (got, want))) if repr(a) != repr(b)]
    return f"{len(bad)} of {len(got[1])} rows differ: {bad[:2]}" if bad else ""
