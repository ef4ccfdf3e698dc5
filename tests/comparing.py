"""Holds a query's rows against those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def sql_rows(sql, sf_dir=None, frames=None):
    con = duckdb.connect()
    for t in TABLES if sf_dir else ():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, frame in (frames or {}).items():
        con.register(name, frame)
    out = con.sql(sql)
    return list(out.columns), out.fetchall()


def assert_same(df, columns, rows):
    assert sorted(df.columns) == sorted(columns)
    place = [df.columns.index(c) for c in columns]
    got = sorted((tuple(normal(r[i]) for i in place) for r in df.collect()), key=repr)
    assert got == sorted((tuple(normal(x) for x in r) for r in rows), key=repr)
