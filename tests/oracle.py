"""Compares a query's rows with its SQL's, without regard to order."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(columns, rows):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in by) for r in rows), key=repr)


def same(spark, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    rows = [tuple(r) for r in df.collect()]
    assert ordered(df.columns, rows) == ordered(names, got.fetchall())
    return len(rows)
