"""Runs registered queries on Spark and their SQL on DuckDB and compares the results.

    python tests/parity.py [data folder] [query name or prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def table_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, query) -> tuple[str, int, float]:
    began = time.time()
    df = query.run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if query.sql is None:
        return ("rows only" if rows else "NO ROWS"), len(rows), took
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    theirs = table_of(cur.fetchall(), names)
    ours = table_of(rows, df.columns)
    if ours[0] != theirs[0]:
        return f"COLUMNS {ours[0]} / {theirs[0]}", len(rows), took
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        only_ours, only_theirs = sorted(a - b)[:3], sorted(b - a)[:3]
        return (f"VALUES {ours[0]} rows {len(ours[1])}/{len(theirs[1])}\n    spark {only_ours}\n"
                f"    sql   {only_theirs}"), len(rows), took
    return ("same" if rows else "same but NO ROWS"), len(rows), took


def main() -> int:
    from shoptally.plans import all_queries
    from shoptally.session import build

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build(master="local[8]", spark__ui__enabled="false",
                  spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, query in all_queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            verdict, n, took = compare(spark, con, folder, query)
        except Exception as problem:
            verdict, n, took = f"ERROR {type(problem).__name__}: {str(problem)[:600]}", 0, 0.0
        bad += verdict not in ("same", "rows only")
        print(f"{name:40s} {n:7d} {took:6.2f}s {verdict}", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
