"""Holds a query's rows against those of its SQL in DuckDB."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connection(sf_dir=SF):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def same(df, con, sql):
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in got.fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
