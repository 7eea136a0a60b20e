"""Runs a query and its SQL on the same tables and compares the rows."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder: str = FOLDER):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:26]
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def same(spark, query, sql, folder: str = FOLDER):
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return
    with connection(folder) as c:
        r = c.sql(sql)
        names = list(r.columns)
        theirs = rows(names, r.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert mine == theirs
