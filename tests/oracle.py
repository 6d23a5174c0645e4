"""Compares a query with its SQL in DuckDB: columns sorted by name, rows in any order, floats to six digits."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(row):
    return tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in row)


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(sf_dir) / t}.parquet')")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), [cells(r[i] for i in order) for r in out.fetchall()]


def rows_of_query(df):
    names = sorted(df.columns)
    return names, [cells(r) for r in df.select(*names).collect()]


def difference(df, sql, sf_dir):
    """None where they agree, or what differs."""
    names, got = rows_of_query(df)
    other, want = rows_of_sql(sql, sf_dir)
    if names != other:
        return f"columns {names} and {other}"
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    if got != want:
        first = next(((a, b) for a, b in zip(got, want) if a != b), None)
        return f"{len(got)} and {len(want)} rows; first {first}"
    return None
