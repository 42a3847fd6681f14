"""Run registered queries in Spark and their SQL in DuckDB and compare all rows.

    python tests/oracle_check.py [sf dir] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return db


def canonical(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(canonical(r[n]) for n in names) for r in df.collect()]
    return names, sorted(rows, key=str)


def duck_rows(db, sql):
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    index = [columns.index(n) for n in names]
    rows = [tuple(canonical(r[i]) for i in index) for r in result.fetchall()]
    return names, sorted(rows, key=str)


def compare(spark, db, name, run, sql, sf_dir):
    got_names, got = spark_rows(run(spark, sf_dir))
    if sql is None:
        return f"rows only ({len(got)})" if got else "EMPTY"
    want_names, want = duck_rows(db, sql)
    if got_names != want_names:
        return f"COLUMNS {set(got_names) ^ set(want_names)}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"VALUES {len(bad)} of {len(got)}: {got_names}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return f"ok ({len(got)})" if got else "EMPTY"


def main():
    from __spark_entry__ import oracle_sql, queries
    from plumbline.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls, failed = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            outcome = compare(spark, db, name, run, sqls.get(name), sf_dir)
        except Exception as error:
            outcome = f"ERROR {type(error).__name__}: {str(error)[:300]}"
        failed += not outcome.startswith(("ok", "rows only"))
        print(f"{name:45s} {time.time() - start:6.2f}s  {outcome}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
