"""Rows of a query and of its DuckDB SQL, made comparable."""

import glob
import os

import duckdb


def same(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(same(v) for v in value) if isinstance(value, (list, tuple)) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(same(r[i]) for i in order) for r in found), key=repr)


def check(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = query(spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
