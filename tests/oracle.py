"""A query's rows against those of its DuckDB statement."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(value):
    """One spelling for equal values of both engines."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    return value


def duck_rows(sql: str, folder: str = SMALL, **tables) -> Counter:
    """Rows as sorted-column tuples; `tables` replace those of the folder."""
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        if name in tables:
            con.register(name, tables[name])
        elif path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter((*sorted(names), *(plain(row[i]) for i in order)) for row in got.fetchall())


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter((*names, *(plain(row[c]) for c in names)) for row in df.collect())
