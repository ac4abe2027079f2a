"""Spark results against DuckDB's, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def against_sql(df, sql: str, sf_dir: str, load=True) -> int:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    order = sorted(names)
    want = Counter(tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    got = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    assert got == want, f"only Spark: {list((got - want).items())[:4]}; only SQL: {list((want - got).items())[:4]}; {sum(got.values())} and {sum(want.values())}"
    return sum(got.values())
