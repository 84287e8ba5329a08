"""Side-by-side comparison of a registered query and its SQL twin."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return value
    if hasattr(value, "as_tuple"):
        return round(float(value), 6) + 0.0
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    got = spark_df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    a, b = rows_of(spark_df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; e.g. {[x for x in a if x not in b][:2]} / {[x for x in b if x not in a][:2]}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{sorted(names)}: {x} vs {y}"
    return None
