"""Compare a Spark query with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences found, empty when schema names, counts and all values agree."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected_rows = cur.fetchall()
    got = spark_df.collect()
    out = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns differ: {sorted(set(names) ^ set(spark_df.columns))}"]
    if len(got) != len(expected_rows):
        out.append(f"rows: spark {len(got)} sql {len(expected_rows)}")
    order = sorted(names)
    where = [names.index(n) for n in order]
    a = sorted((tuple(plain(r[n]) for n in order) for r in got), key=key)
    b = sorted((tuple(plain(r[i]) for i in where) for r in expected_rows), key=key)
    wrong = 0
    for x, y in zip(a, b):
        if x != y:
            wrong += 1
            if wrong <= 3:
                out.append(str({n: (p, q) for n, p, q in zip(order, x, y) if p != q})[:600])
    if wrong:
        out.append(f"{wrong} rows differ")
    for i, n in enumerate(order):
        kinds_a = {type(r[i]).__name__ for r in a if r[i] is not None}
        kinds_b = {type(r[i]).__name__ for r in b if r[i] is not None}
        if kinds_a != kinds_b:
            out.append(f"type of {n}: spark {kinds_a} sql {kinds_b}")
    return out
