"""Runs registered queries in Spark and their SQL in DuckDB and compares the results.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(spark, folder: str, run, sql: str | None) -> tuple[bool, str]:
    t = time.time()
    df = run(spark, folder)
    cols, got = rows_of(df.columns, df.collect())
    spent = time.time() - t
    if sql is None:
        return True, f"rows only: {len(got)} rows, {spent:.1f}s"
    con = connect(folder)
    kinds = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    odd = [(c, t, kinds.get(c)) for c, t in df.dtypes if KINDS.get(t, t) != kinds.get(c)]
    if odd:
        return False, f"types (column, spark, sql): {odd}"
    cur = con.execute(sql)
    ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    con.close()
    if cols != ocols:
        return False, f"columns {cols} vs {ocols}"
    if len(got) != len(want):
        return False, f"{len(got)} rows vs {len(want)}"
    for g, w in zip(got, want, strict=True):
        if repr(g) != repr(w):
            return False, f"row {cols}\n  spark {g}\n  sql   {w}"
    return True, f"{len(got)} rows, {spent:.1f}s"


def main() -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from stepline.session import clear_scratch, local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    q, o = entry.queries(), entry.oracle_sql()
    keys = sys.argv[2:] or list(q)
    if len(keys) == 1 and keys[0].startswith("@"):
        keys = [k for k in q if q[k].__module__.endswith(keys[0][1:])]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for k in keys:
        try:
            ok, note = compare(spark, folder, q[k], o.get(k))
        except Exception as e:  # report and go on with the next key
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        if not ok:
            bad.append(k)
        clear_scratch(spark)
        print(f"{'ok  ' if ok else 'FAIL'} {k}: {note}", flush=True)
    print(f"{len(keys) - len(bad)}/{len(keys)} ok; failing: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
