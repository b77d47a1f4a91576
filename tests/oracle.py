"""Compare registered queries with their DuckDB SQL, value by value."""

from __future__ import annotations

import datetime as dt
import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return ("-0" if v == 0 and math.copysign(1, v) < 0 else v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def family(name):
    name = name.lower()
    for key, out in (("bigint", "long"), ("int", "int"), ("double", "double"), ("bool", "bool"),
                     ("timestamp", "time"), ("char", "text"), ("string", "text"), ("blob", "binary"),
                     ("long", "long"), ("float", "float")):
        if key in name:
            return out
    return name


def compare(spark, con, sf_dir, query, sql):
    """None when equal, else a text that tells the difference."""
    t0 = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect())
    t1 = time.time()
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    types = {x[0]: str(x[1]) for x in cur.description}
    want_rows = cur.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in want_rows)
    kinds = {c: (family(t), family(types[c])) for c, t in df.dtypes if family(t) != family(types[c])}
    if kinds:
        return f"types differ: {kinds}"
    if got != want:
        a, b = list((got - want).items())[:2], list((want - got).items())[:2]
        return (f"{sum(got.values())} vs {sum(want.values())} rows; only spark {sum((got - want).values())} "
                f"{str(a)[:600]}; only duckdb {str(b)[:600]}")
    compare.last = (sum(got.values()), t1 - t0, t2 - t1)
    return None
