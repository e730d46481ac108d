"""Run a query and its SQL twin side by side and compare them without order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(path: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for name in TABLES:
        if os.path.exists(f"{path}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return repr(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """``None`` when both agree, else a short description."""
    left_names = spark_df.columns
    left = rows_of(left_names, spark_df.collect())
    cur = con.execute(sql)
    right_names = [d[0] for d in cur.description]
    right = rows_of(right_names, cur.fetchall())
    if sorted(left_names) != sorted(right_names):
        return f"columns {sorted(left_names)} != {sorted(right_names)}"
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)}: {extra}"
    a, b = set(left), set(right)
    if left != right:
        return f"values differ in {len(a - b)} of {len(left)}: {sorted(a - b)[:2]} / {sorted(b - a)[:2]}"
    return None
