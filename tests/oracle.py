"""Holds a query's rows against its SQL in DuckDB."""

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def views():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def same_rows(df, sql):
    con = views()
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.select(*(f"`{c}`" for c in order)).collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
