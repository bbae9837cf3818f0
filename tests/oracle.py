"""Runs a Spark query and its SQL twin on the same tables and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of_sql(con, sql: str):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(norm(row[i]) for i in order) for row in r.fetchall()), key=repr), {d[0]: str(d[1]) for d in r.description}


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(x) for x in r) for r in df.select(*names).collect()), key=repr), dict(df.dtypes)
