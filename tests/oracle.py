"""Run a registered query and its oracle SQL on the same tables and compare."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute("SET TimeZone='UTC'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_norm(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    problems = []
    if sorted(cols) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(cols)}")
    elif len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    elif [tuple(map(repr, r)) for r in got] != [tuple(map(repr, r)) for r in want]:
        bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
        problems.append(f"{len(bad)} rows differ, first: {bad[:2]}")
    return problems, len(got), took


def main(argv):
    from spanloom.plans.catalog import ORACLES, QUERIES
    from spanloom.session import local_session

    sf = next((a for a in argv if a.startswith("/")), "/root/testdata/sf0.01")
    picks = [a for a in argv if not a.startswith("/")]
    spark = local_session("oracle")
    con = connect(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if picks and not any(p in name for p in picks):
            continue
        try:
            if name in ORACLES:
                problems, n, took = compare(spark, con, name, fn, ORACLES[name], sf)
            else:
                t0 = time.time()
                n, problems = len(fn(spark, sf).collect()), []
                took = time.time() - t0
        except Exception as exc:  # noqa: BLE001
            problems, n, took = [f"{type(exc).__name__}: {str(exc)[:400]}"], -1, 0.0
        mark = "ok  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{mark} {name:40s} rows={n:6d} {took:6.2f}s {'' if name in ORACLES else '(rows only)'}", flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
