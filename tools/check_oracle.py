"""Run registered queries in Spark and their SQL twins in DuckDB and compare values.

Usage: python tools/check_oracle.py [--sf DIR] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from terrasift.plans import registry  # noqa: E402
from terrasift.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def normal(v):
    """Comparable form; keeps int and float apart, as a strict value hash would."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        return f"f:{v + 0.0!r}"
    if isinstance(v, int):
        return f"i:{v}"
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    bad = 0
    for name, q in registry.load().items():
        if args.names and not any(name.startswith(n) or n in q.ops for n in args.names):
            continue
        try:
            t0 = time.time()
            df = q.build(spark, args.sf)
            got = df.collect()
            t1 = time.time()
        except Exception as exc:  # report and go on
            print(f"FAIL  {name}: spark: {str(exc)[:700]}", flush=True)
            bad += 1
            continue
        if q.sql is None:
            print(f"rows  {name}: {len(got)} rows {t1 - t0:.2f}s", flush=True)
            continue
        try:
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
        except Exception as exc:
            print(f"FAIL  {name}: sql: {str(exc)[:700]}", flush=True)
            bad += 1
            continue
        t2 = time.time()
        if sorted(cols) != sorted(df.columns):
            print(f"FAIL  {name}: columns {sorted(df.columns)} vs {sorted(cols)}", flush=True)
            bad += 1
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if a != b:
            bad += 1
            sb, sa = set(b), set(a)
            only_a = [r for r in a if r not in sb][:2]
            only_b = [r for r in b if r not in sa][:2]
            set_b, set_a = sb, sa
            na, nb = sum(r not in set_b for r in a), sum(r not in set_a for r in b)
            print(f"FAIL  {name}: {len(a)} vs {len(b)} rows, differing {na}/{nb}\n   cols {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}", flush=True)
        else:
            print(f"ok    {name}: {len(a)} rows spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s", flush=True)
    print(f"{bad} failing", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
