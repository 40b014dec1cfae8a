"""Runs a registered query and its checking SQL on the same tables and compares rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, entry, sf):
    """None when equal, otherwise a short text of the first differences."""
    df = entry.run(spark, sf)
    got_cols, got = rows(df.columns, df.collect())
    cur = con.execute(entry.sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    kinds = dict(df.dtypes)
    duck_kinds = {d[0]: str(d[1]) for d in cur.description}
    same = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "date": {"DATE"}}
    off = [(c, kinds[c], duck_kinds[c]) for c in got_cols if kinds[c] in same and duck_kinds[c] not in same[kinds[c]]]
    other = [(c, kinds[c]) for c in got_cols if kinds[c] not in same]
    if len(got) != len(want) or got != want:
        g, w = set(got), set(want)
        only_got = [r for r in got if r not in w][:3]
        only_want = [r for r in want if r not in g][:3]
        return f"rows {len(got)} vs {len(want)}\n   cols {got_cols}\n   spark only {only_got}\n   sql only   {only_want}"
    if not got:
        return "EMPTY RESULT"
    if off or other:
        return f"TYPES {off} {other}"
    return None
