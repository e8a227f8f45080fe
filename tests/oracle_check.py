"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

    python tests/oracle_check.py [sf_dir] [query ...]

Comparison: same column names (sorted), same row count, same type family,
and the same multiset of rows with exact values.  Also prints the largest
absolute difference of float columns to show how far from a rounding edge a
result is.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT",
                 "tinyint": "TINYINT", "timestamp": "TIMESTAMP", "date": "DATE"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "item"):
        return v.item()
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    order = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    d_rows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    msgs = []
    ok = True
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    for c in s_cols:
        if SPARK_TO_DUCK.get(s_types[c], s_types[c]) != d_types[c]:
            ok = False
            msgs.append(f"type {c}: spark={s_types[c]} duck={d_types[c]}")
    if len(s_rows) != len(d_rows):
        return False, f"rows differ: spark={len(s_rows)} duck={len(d_rows)}; " + "; ".join(msgs)
    s_sorted, d_sorted = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    mism = 0
    maxdiff = 0.0
    first = None
    for a, b in zip(s_sorted, d_sorted):
        if a != b:
            mism += 1
            first = first or (a, b)
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                maxdiff = max(maxdiff, abs(x - y))
    if mism:
        ok = False
        msgs.append(f"{mism} rows differ; first spark={first[0]} duck={first[1]}")
    msgs.append(f"rows={len(s_rows)} maxdiff={maxdiff:.3g}")
    return ok, "; ".join(msgs)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from residuum.session import build_session
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    sql = oracle_sql()
    failed = []
    for name, q in queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        df = q(spark, sf_dir)
        if name not in sql:
            n = df.count()
            print(f"[rows-only] {name}: {n} rows ({time.time() - t:.1f}s)")
            continue
        try:
            ok, msg = compare(df, con, sql[name])
        except Exception as e:  # report and go on
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:500]}"
        print(f"[{'ok' if ok else 'FAIL'}] {name}: {msg} ({time.time() - t:.1f}s)")
        if not ok:
            failed.append(name)
    print("FAILED:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
