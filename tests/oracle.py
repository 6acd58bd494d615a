"""Run registered queries on Spark and their SQL on DuckDB, and compare all rows.

    python -m tests.oracle [-d DIR] [key-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _key(row):
    return tuple((v is not None, type(v).__name__, v) for v in row)


def rows_of(cols, data):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in idx], sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=_key)


def compare(df, con, sql: str) -> tuple[bool, str]:
    t0 = time.time()
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    d_cols, d_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    took = f"spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"
    if s_cols != d_cols:
        return False, f"columns {s_cols} != {d_cols}"
    if len(s_rows) != len(d_rows):
        only_s = [r for r in s_rows if r not in set(d_rows)][:3]
        only_d = [r for r in d_rows if r not in set(s_rows)][:3]
        return False, f"rows {len(s_rows)} != {len(d_rows)}\n  spark only {only_s}\n  sql only   {only_d}"
    for a, b in zip(s_rows, d_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return False, f"cols {s_cols}\n  spark {a}\n  sql   {b}"
    return True, f"{len(s_rows)} rows ({took})"


def main(argv):
    import __spark_entry__ as entry
    from memlake.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["-d"]:
        sf, argv = argv[1], argv[2:]
    spark = local_session()
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    keys = [k for k in queries if not argv or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in argv)]
    bad = []
    for k in keys:
        start = time.time()
        try:
            df = queries[k](spark, sf)
            if k in sqls:
                ok, note = compare(df, con, sqls[k])
            else:
                ok, note = True, f"{len(df.collect())} rows (no SQL)"
            if note.startswith("0 rows"):
                note += "  <-- EMPTY"
        except Exception as e:  # report and go on with the next key
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        if not ok:
            bad.append(k)
        print(f"{'ok  ' if ok else 'FAIL'} {k} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(keys) - len(bad)}/{len(keys)} ok; failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
