"""Runs a query and its SQL over the same tables and compares them as unordered rows."""

import math
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def tables(folder):
    out = duckdb.connect()
    for name in os.listdir(folder):
        out.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return out


def assert_equal(spark, base, query, sql, folder):
    frame = query(spark, folder)
    told = base.execute(sql)
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(names, told.fetchall())
