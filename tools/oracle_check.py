"""Run registered queries on Spark and their SQL twins on DuckDB and compare the results.

usage: python tools/oracle_check.py [--sf 0.01] [pattern ...]
"""
from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from recoup.plans import oracle_sql, queries  # noqa: E402
from recoup.session import build_session  # noqa: E402
from recoup.sources.tables import BASE  # noqa: E402

DUCK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
        "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT": "float"}


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (decimal.Decimal, datetime.date)):
        return str(v)
    return repr(v)


def run(names, sf, sql_only=False):
    spark = build_session()
    con = duckdb.connect()
    con.execute("set threads=8")
    for t in BASE:
        con.execute(f"create view {t} as select * from '/root/testdata/sf{sf}/{t}.parquet'")
    qs, sql = queries(), oracle_sql()
    bad, slow = [], []
    for name in qs:
        if sql_only and name not in sql:
            continue
        if names and not any(re.search(p, name) for p in names):
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, f"/root/testdata/sf{sf}")
            rows = df.collect()
            schema = {f.name: f.dataType.simpleString() for f in df.schema}
        except Exception as e:
            print(f"ERROR  {name}: {str(e)[:600]}")
            bad.append(name)
            continue
        t1 = time.time()
        if name not in sql:
            print(f"rows   {name} {len(rows)} rows {t1 - t0:.1f}s")
            if os.environ.get("SHOW"):
                df.show(20, False)
            continue
        try:
            rel = con.sql(sql[name])
            types = {c: DUCK.get(str(d), str(d)) for c, d in zip(rel.columns, rel.types)}
            other = rel.fetchall()
        except Exception as e:
            print(f"SQLERR {name}: {str(e)[:600]}")
            bad.append(name)
            continue
        t2 = time.time()
        cols = sorted(schema)
        if cols != sorted(types):
            print(f"COLS   {name}: {cols} vs {sorted(types)}")
            bad.append(name)
            continue
        ia = {c: i for i, c in enumerate(df.columns)}
        ib = {c: i for i, c in enumerate(rel.columns)}
        a = sorted(tuple(norm(r[ia[c]]) for c in cols) for r in rows)
        b = sorted(tuple(norm(r[ib[c]]) for c in cols) for r in other)
        types_off = {c: (schema[c], types[c]) for c in cols if schema[c] != types[c]}
        if a != b:
            sa, sb = set(a), set(b)
            print(f"DIFF   {name}: {len(a)} vs {len(b)} rows {cols}\n   spark {sorted(sa - sb)[:3]}\n"
                  f"   duck  {sorted(sb - sa)[:3]}  types {types_off}")
            bad.append(name)
        elif types_off:
            print(f"TYPE   {name}: {types_off}")
            bad.append(name)
        elif not a:
            print(f"EMPTY  {name}")
        else:
            print(f"ok     {name} {len(a)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s")
            if os.environ.get("SHOW"):
                df.show(20, False)
    print("bad:", bad)


if __name__ == "__main__":
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("--sql", action="store_true", help="only queries with a SQL twin")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    run(a.names, a.sf, a.sql)
