"""Side-by-side runs of the registered queries and their SQL."""

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return db


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if value.is_integer() and not math.isinf(value):
            return int(value)
        return round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)
    return names, plain


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(db, sql):
    cursor = db.execute(sql)
    return rows_of([c[0] for c in cursor.description], cursor.fetchall())


def difference(left, right, show=3):
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return ""
    a, b = set(left[1]), set(right[1])
    return (
        f"{len(left[1])} rows against {len(right[1])}; only left {sorted(a - b, key=repr)[:show]}; "
        f"only right {sorted(b - a, key=repr)[:show]}"
    )
