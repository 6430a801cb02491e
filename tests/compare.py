"""Rows of a Spark and a DuckDB result as comparable lists."""

import datetime as dt
import math


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(relation):
    columns = sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[k]) for k in at) for r in relation.fetchall()), key=repr)


def same(df, relation):
    a, b = spark_rows(df), duck_rows(relation)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1]):
        assert x == y
