"""Rows of a DataFrame and of an oracle, as sorted tuples of plain text."""

import math


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.9g}" if not float(x).is_integer() else str(int(x))
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(v[k]) for k in order) for v in values)


def same(df, con, sql):
    got = df.collect()
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    return rows(df.columns, got), rows(rel.columns, rel.fetchall())
