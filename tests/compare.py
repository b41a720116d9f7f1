"""Results of both engines in one form."""

import decimal


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 8) if isinstance(v, float) and v == v else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


def same(df, duck, sql):
    want = duck.sql(sql)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
