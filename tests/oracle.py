"""Rows of a Spark query and of its DuckDB text, made comparable."""

import math
from datetime import datetime
from decimal import Decimal

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_cell(r[i]) for i in order] for r in data), key=repr)


def duck(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    done = con.execute(sql)
    return [d[0] for d in done.description], done.fetchall()


def same(df, sql, sf=SF):
    """Compare; the number of rows."""
    columns, data = duck(sql, sf)
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, data)
    assert len(got) == len(want)
    assert got == want
    return len(got)
