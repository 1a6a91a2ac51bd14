"""Compares a query with its SQL in DuckDB over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_as_sql(spark, query, sql, sf="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    got = query(spark, sf)
    rows = con.execute(sql)
    names = sorted(d[0] for d in rows.description)
    at = [[d[0] for d in rows.description].index(n) for n in names]
    assert names == sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r[i] for i in at) for r in rows.fetchall()), key=key)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == want
    assert want
