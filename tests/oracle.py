"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

    python -m tests.oracle [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def spark_session(app="curbside-tests", cpus="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    """A comparable value; the second item tells its kind."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return float(v) if v != int(v) else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sort_key(row):
    return tuple((v is not None, type(v).__name__ if not isinstance(v, (int, float)) else "num",
                  round(v, 5) if isinstance(v, float) else v) if v is not None else (False, "", 0) for v in row)


def same(a, b, tol=1e-9):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, str) or isinstance(b, str):
            return a == b
        return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, dt.datetime) != isinstance(b, dt.datetime) and isinstance(a, dt.date) and isinstance(b, dt.date):
        return False
    return a == b


def compare(spark, con, name, fn, sql, sf):
    """None when equal, else a message. Also reports values that differ only in the last digits."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if sql is None:
        return None if got or not df.columns else "no rows", len(got), 0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(got), 0
    order = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got), 0
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    inexact = 0
    for g, w in zip(got, want):
        if not all(same(x, y) for x, y in zip(g, w)):
            return f"{cols}: {g} vs {w}", len(got), inexact
        if g != w:
            inexact += 1
            if inexact == 1 and os.environ.get("SHOW_INEXACT"):
                print("   ", [(c, x, y) for c, x, y in zip(cols, g, w) if x != y])
    return None, len(got), inexact


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = spark_session(), duck(sf)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem, n, inexact = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001 - the tool reports every failure
            problem, n, inexact = f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        mark = "ok  " if problem is None else "FAIL"
        note = "" if name in oracles else " (rows only)"
        note += f" inexact={inexact}" if inexact else ""
        print(f"{mark} {name:45s} {n:7d} rows {time.time() - start:6.2f}s{note}", flush=True)
        if problem:
            print("     ", problem, flush=True)
            bad.append(name)
    print(f"{len(bad)} failed: {bad}" if bad else "all equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
