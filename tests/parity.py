"""Runs a registered query beside its SQL oracle and compares the rows."""

from __future__ import annotations

import math
import os

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(con, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return _rows(columns, found.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, oracle {len(want[1])}" + _sample(got[1], want[1])
    return None if got[1] == want[1] else "rows differ" + _sample(got[1], want[1])


def _sample(got, want) -> str:
    g, w = set(map(repr, got)), set(map(repr, want))
    return f"\n  only spark: {sorted(g - w)[:2]}\n  only oracle: {sorted(w - g)[:2]}"[:1500]
