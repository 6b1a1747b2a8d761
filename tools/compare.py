"""Run registered queries on Spark and their SQL on DuckDB and report differences.

usage: python tools/compare.py SF_DIR [name-fragment ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from panelloom.plans import load_registry
from panelloom.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, q, sf: str) -> str:
    t0 = time.time()
    df = q.run(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if q.sql is None:
        return f"ROWS  {len(got):7d} {t1 - t0:6.1f}s"
    cur = con.execute(q.sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    head = f"{len(got):7d} {t1 - t0:6.1f}s sql {t2 - t1:5.1f}s"
    if got_cols != want_cols:
        return f"FAIL  {head} columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"FAIL  {head} rows {len(got)} != {len(want)}\n    {got[:2]}\n    {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        shown = "\n".join(f"    {g}\n    {w}" for g, w in bad[:3])
        return f"FAIL  {head} differing rows {len(bad)}\n{shown}"
    return ("OK    " if got else "EMPTY ") + head


if __name__ == "__main__":
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    counts: dict[str, int] = {}
    for name, q in load_registry().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            line = compare(spark, con, q, sf)
        except Exception as exc:  # report and go on with the next query
            line = "ERROR " + str(exc)[:1500]
        counts[line[:5].strip()] = counts.get(line[:5].strip(), 0) + 1
        print(f"{name:40s} {line}", flush=True)
    print(counts)
