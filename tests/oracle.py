"""Run registered queries against DuckDB: ``python -m tests.oracle [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def compare(df, con, sql):
    """Return (ok, message)."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(names):
        return False, f"columns {cols} != {sorted(names)}"
    pos = [names.index(c) for c in cols]
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    exp = [tuple(_norm(r[p]) for p in pos) for r in want]
    key = lambda r: tuple((type(v).__name__ if v is not None else "", str(v)) for v in r)
    got.sort(key=key)
    exp.sort(key=key)
    if len(got) != len(exp):
        return False, f"rows {len(got)} != {len(exp)}; got {got[:2]} want {exp[:2]}"
    types = lambda rows: [{type(v).__name__ for v in c if v is not None} for c in zip(*rows)]
    if got != exp or types(got) != types(exp):
        bad = [(g, e) for g, e in zip(got, exp) if g != e][:2]
        return False, f"values differ ({sum(g != e for g, e in zip(got, exp))} of {len(got)}) on {cols}: {bad} types {types(got)} {types(exp)}"
    return True, f"{len(got)} rows"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from mediasift.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(os.environ.get("CPUS", "8")), connect(sf)
    if "BLOCK_ROWS" in os.environ:
        spark.conf.set("mediasift.block.rows", os.environ["BLOCK_ROWS"])
    q, o = entry.queries(), entry.oracle_sql()
    names = [n for n in q if not argv or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = q[n](spark, sf)
            if n in o:
                ok, msg = compare(df, con, o[n])
            else:
                rows = df.collect()
                ok, msg = len(rows) > 0, f"{len(rows)} rows, no SQL; {rows[:1]}"
        except Exception as e:
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t0:.1f}s {msg[:1500]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
