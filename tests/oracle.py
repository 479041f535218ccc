"""Run a registered query and its SQL and compare the results value by value."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if value is None:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None if both agree, else what differs."""
    df = run(spark, sf_dir)
    mine = df.collect()
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    left, right = _bag(df.columns, mine), _bag(columns, theirs)
    if left == right:
        return None if mine else "both empty"
    only_left, only_right = left - right, right - left
    return (
        f"{len(mine)} against {len(theirs)} rows; only here {list(only_left.items())[:3]}; "
        f"only SQL {list(only_right.items())[:3]}"
    )
