"""Compare registered queries against their DuckDB SQL: python tests/oracle.py SF_DIR NAME..."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if v is not None and type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def _sorted(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = _sorted(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"{len(got)} and {len(want)} rows; {odd}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    import __spark_entry__ as e
    from tests.conftest import session

    spark, (sf, *names) = session(), sys.argv[1:]
    for name in names or e.queries():
        t = time.time()
        sql = e.oracle_sql().get(name)
        if sql:
            said = differences(spark, e.queries()[name], sql, sf) or "same"
        else:
            said = f"{e.queries()[name](spark, sf).count()} rows, no SQL"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
