"""Runs a registered query in Spark and its SQL in DuckDB, and compares rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def differs(spark, sf: str, run, sql: str) -> str:
    df = run(spark, sf)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    rel = duck(sf).sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    for c, t in df.dtypes:
        want = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}.get(t, kinds[c])
        if want != kinds[c]:
            return f"{c}: {t} and {kinds[c]}"
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only mine {list((mine - theirs).items())[:2]}; only theirs {list((theirs - mine).items())[:2]}"
    return "" if mine else "no rows"
