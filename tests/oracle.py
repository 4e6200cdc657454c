"""Comparison of a query's rows with its SQL's, as multisets."""

import os

import duckdb


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return repr(v) if isinstance(v, float) else str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    df = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(df.columns, df.collect()) == canon(names, cur.fetchall())
