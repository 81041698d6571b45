"""Compares queries with their SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def difference(df, sql: str, con) -> str | None:
    """What differs, None if nothing does."""
    cursor = con.execute(sql)
    wanted_columns = [d[0] for d in cursor.description]
    wanted = canonical(cursor.fetchall(), wanted_columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if sorted(df.columns) != sorted(wanted_columns):
        return f"columns {sorted(df.columns)} and {sorted(wanted_columns)}"
    if len(got) != len(wanted):
        a, b = set(map(str, got)), set(map(str, wanted))
        return f"{len(got)} rows and {len(wanted)}; only ours {list(a - b)[:3]}; only SQL {list(b - a)[:3]}"
    for x, y in zip(got, wanted):
        if x != y:
            return f"{x}\n   {y}"
    return None
