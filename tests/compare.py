"""Run registered queries on Spark and their check SQL on DuckDB; compare rows as sorted text."""

from __future__ import annotations

import os
import sys
import time

import duckdb

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
        "labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
    return repr(value) if not isinstance(value, (int, bool)) else str(int(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, entry, sf_dir):
    from linkloom.sources.views import Tables

    start = time.time()
    df = entry.run(Tables(spark, sf_dir))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if entry.sql is None:
        return True, len(got[1]), took, "no check SQL"
    cur = con.execute(entry.sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, len(got[1]), took, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, len(got[1]), took, f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return not bad, len(got[1]), took, (f"{len(bad)} differ, first {bad[0]}"[:1500] if bad else "")


def main(names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from linkloom.plans import catalog
    from linkloom.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = []
    for name, entry in catalog().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, n, took, why = compare(spark, con, entry, sf_dir)
        except Exception as exc:  # noqa: BLE001 - report every failing query
            ok, n, took, why = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:1200]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} rows={n} {took:.2f}s {why}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
