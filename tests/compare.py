"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""
from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bourselake.sources.market import TABLES  # noqa: E402


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return None if math.isnan(number) else number + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value.isoformat() if isinstance(value, dt.date) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, root, name, run, sql):
    """None when equal, otherwise a short description of the difference."""
    df = run(spark, root)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        return f"rows {len(got)} vs {len(want)}, {len(diff)} differ, first {diff[:2]}"
    return None


if __name__ == "__main__":
    from bourselake.plans import registry
    from bourselake.session import build_session

    import os
    root = os.environ.get("COMPARE_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    runs, sqls = registry.queries(), registry.oracle_sql()
    entries = registry.load()
    wanted = sys.argv[1:]
    bad = 0
    for name, run in runs.items():
        module = entries[name].run.__module__.rsplit(".", 1)[-1]
        if wanted and name not in wanted and f"@{module}" not in wanted:
            continue
        started = time.time()
        try:
            problem = check(spark, con, root, name, run, sqls.get(name))
            count = ""
            if problem is None:
                count = str(run(spark, root).count()) if "-n" in sys.argv else ""
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem:
            bad += 1
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - started:.1f}s {count if not problem else ''}"
              f"{' [rows only]' if name not in sqls else ''} {problem or ''}", flush=True)
    print("bad:", bad)
