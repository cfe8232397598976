"""Runs a query in Spark and its SQL in DuckDB over the same tables."""

import math
import os

import duckdb

from matchloom.tables import TABLES

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (bool, int)):
        return v
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def same(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(canon(r[c]) for c in cols)) for r in df.collect())
    found = connect(sf_dir).sql(sql)
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    theirs = sorted(repr(tuple(canon(r[i]) for i in at)) for r in found.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
