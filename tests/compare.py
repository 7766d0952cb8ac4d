"""Runs a query in Spark and its SQL in DuckDB and compares schema and rows."""

from __future__ import annotations

import math
import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


TIMES = {"sql": 0.0}

KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
        "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def compare(df, con, sql: str) -> list[str]:
    """Differences between the two results, as text; empty if they agree."""
    t0 = time.time()
    cur = con.execute(sql)
    duck_schema = {d[0]: str(d[1]) for d in cur.description}
    duck = cur.fetchall()
    TIMES["sql"] = time.time() - t0
    cols = sorted(duck_schema)
    out = []
    if sorted(df.columns) != cols:
        return [f"columns {sorted(df.columns)} != {cols}"]
    for name, kind in df.dtypes:
        if KIND.get(kind, kind) != duck_schema[name]:
            out.append(f"type of {name}: {kind} != {duck_schema[name]}")
    dnames = [d[0] for d in cur.description]
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    b = sorted(tuple(_norm(r[dnames.index(c)]) for c in cols) for r in duck)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        out.append(f"cols {cols}")
        out.append(f"only spark: {sorted(sa - sb)[:3]}")
        out.append(f"only sql:   {sorted(sb - sa)[:3]}")
    return out
