"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    got = query(spark, sf_dir)
    cols = sorted(got.columns)
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert key(got.select(cols).collect()) == key([[r[i] for i in at] for r in done.fetchall()])
