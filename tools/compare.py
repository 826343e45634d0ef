"""Run queries next to their SQL and compare values: compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.session import local_session  # noqa: E402
from workload import ORACLES, QUERIES  # noqa: E402


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(map(canonical, value.values())) + "}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir, name):
    """(verdict, rows, seconds) of one query."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    seconds = time.time() - start
    if name not in ORACLES:
        return "no sql", len(got), seconds
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got), seconds
    if got != want:
        extra = [r for r in set(got) - set(want)][:2]
        missing = [r for r in set(want) - set(got)][:2]
        return (
            f"MISMATCH {len(got)} vs {len(want)}\n   only spark: {str(extra)[:900]}"
            f"\n   only sql:   {str(missing)[:900]}", len(got), seconds,
        )
    return "ok", len(got), seconds


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            verdict, n, seconds = compare(spark, con, sf_dir, name)
        except Exception as failure:
            verdict, n, seconds = f"ERROR {type(failure).__name__}: {str(failure)[:1500]}", 0, 0
        bad += verdict not in ("ok", "no sql")
        print(f"{name:28s} {n:8d} rows {seconds:6.2f}s  {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
