"""Runs a registered job and its SQL twin and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from lexicue.plans import JOBS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return str(v)
    if v is None:
        return "<null>"
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, name: str, folder: str) -> str:
    """Empty when both sides agree, else the reason."""
    job = JOBS[name]
    t0 = time.time()
    df = job.run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    note = f"{len(got)} rows {t1 - t0:.1f}s"
    if job.sql is None:
        print(f"   {name}: {note}, no sql", flush=True)
        return "" if got else "no rows"
    cur = con.execute(job.sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    print(f"   {name}: {note}, sql {time.time() - t1:.1f}s", flush=True)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows(df.columns, got), rows(cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}; only spark {list(set(a) - set(b))[:3]} only sql {list(set(b) - set(a))[:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ of {len(a)}, first: {bad[0]}"
    kinds = lambda data, c: {k: type(v).__name__ for k, v in zip(c, data[0])} if data else {}
    ka, kb = kinds(got, df.columns), kinds(want, cols)
    odd = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c] and "NoneType" not in (ka[c], kb[c])}
    if odd:
        return f"types {odd}"
    if not got:
        return "no rows"
    return ""


if __name__ == "__main__":
    from lexicue.session import build

    folder = sys.argv[1]
    names = [n for n in JOBS if not sys.argv[2:] or any(a in n for a in sys.argv[2:])]
    spark = build("local[8]", "compare", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    con = connect(folder)
    failed = 0
    for n in names:
        try:
            why = compare(spark, con, n, folder)
        except Exception as e:  # noqa: BLE001 - report and go on
            why = f"{type(e).__name__}: {str(e)[:900]}"
        if why:
            failed += 1
            print("FAIL", n, why, flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
