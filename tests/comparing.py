"""Comparing a query's rows with those of its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    """What differs, in words; empty if columns and rows are the same."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(columns)}"]
    want = rows_of(columns, cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    if got == want:
        return []
    extra, lack = set(got) - set(want), set(want) - set(got)
    return [f"{len(got)} rows and {len(want)}", f"only here: {list(extra)[:3]}", f"only in SQL: {list(lack)[:3]}"]
