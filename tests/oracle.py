"""Rows of a query and of its SQL, made comparable."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connection(sf_dir=DATA):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, (int, float, decimal.Decimal)) else v


def rows(found, columns, order):
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in found), key=str)


def same(df, sql, con):
    order = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == order
    assert rows(df.collect(), df.columns, order) == rows(rel.fetchall(), rel.columns, order)
