"""Holds a query's rows against its SQL on DuckDB, on the driver's tables."""

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf=SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if glob.glob(path + '/*') else path}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def same(df, con, sql):
    got_cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == got_cols, (sorted(names), got_cols)
    at = [names.index(c) for c in got_cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in got_cols) for r in df.collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]
    return len(got)
