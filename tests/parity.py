"""Comparison of a Spark result with the rows that DuckDB finds."""

import numpy as np


def plain(x):
    if x is None or isinstance(x, (str, bytes, bool, int)):
        return x
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "item"):
        return plain(x.item())
    return float(x) if type(x).__name__ == "Decimal" else x


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)


def duck_rows(con, sql):
    r = con.execute(sql)
    cols = [c[0] for c in r.description]
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(cols), sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=str)


def same(df, con, sql):
    (a, x), (b, y) = spark_rows(df), duck_rows(con, sql)
    assert a == b
    assert x == y, (sorted(set(x) - set(y))[:3], sorted(set(y) - set(x))[:3])
