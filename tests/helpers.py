"""Comparing a query with its SQL, as sorted rows of canonical values."""

import math
import os

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return c


def canonical(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([canonical(x) for x in v])
    return str(v)


def same(df, con, sql: str) -> None:
    got = df.collect()
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted(str([canonical(row[n]) for n in order]) for row in got)
    b = sorted(str([canonical(row[names.index(n)]) for n in order]) for row in r.fetchall())
    assert a == b
