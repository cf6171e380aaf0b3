"""Spark rows against DuckDB rows, whatever their order."""

import decimal
import math


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return float("%.9g" % v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want
    return len(got)
