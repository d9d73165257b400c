"""Comparing a DataFrame with expected rows, and Spark with DuckDB."""

import glob
import os


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return round(float(value), 5)
    return str(value)


def duck(sql, folder):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    c.execute(sql)
    names = [d[0] for d in c.description]
    return sorted((tuple(plain(dict(zip(names, r, strict=True))[n]) for n in sorted(names)) for r in c.fetchall()), key=repr), sorted(names)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr), names
