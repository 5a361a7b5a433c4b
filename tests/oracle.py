"""Compare a query's rows with its SQL on DuckDB: column names, row count and values, in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, d):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def canon(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ("", )
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return ("n", round(float(x), 6) + 0.0)
    return ("s", str(x))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def same(df, sql, d):
    names, data = sql_rows(sql, d)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, data)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b, strict=True):
        close = all(p == q or (p[0] == q[0] == "n" and abs(p[1] - q[1]) <= 2e-6 * max(1, abs(q[1]))) for p, q in zip(x, y, strict=True))
        assert close, (x, y)
