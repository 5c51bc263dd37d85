"""Run a registered query in Spark and its oracle SQL in DuckDB, compare the results.

Usable from pytest and as a script: ``python tests/oracle_compare.py [sf_dir] [key ...]``.
Comparison: same column names (sorted), same row count, same multiset of rows;
floats must be equal exactly (both sides round to fixed decimals where needed).
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck_for(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "nan")
        return (1, repr(float(v)))
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, int):
        return (3, str(v))
    return (4, str(v))


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, sorted(rows), {f.name: f.dataType.simpleString() for f in df.schema.fields}


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    types = dict(zip(names, [str(t) for t in rel.types]))
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, sorted(rows), types


_TYPE_EQ = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT",
    "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
}


def compare(spark, con, key: str, sf_dir: str, fn, sql: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    s_cols, s_rows, s_types = spark_rows(df)
    d_cols, d_rows, d_types = duck_rows(con, sql)
    if s_cols != d_cols:
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    bad_types = [c for c in s_cols if _TYPE_EQ.get(s_types[c], s_types[c]) != d_types[c]]
    if bad_types:
        return False, "types differ: " + ", ".join(f"{c}: {s_types[c]} vs {d_types[c]}" for c in bad_types)
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    if s_rows != d_rows:
        diffs = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        return False, f"values differ ({sum(a != b for a, b in zip(s_rows, d_rows))} rows), e.g. {diffs}"
    return True, f"{len(s_rows)} rows"


def main(argv: list[str]) -> int:
    from lendscope.session import local_session
    import __spark_entry__ as E

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:]
    spark = local_session()
    con = duck_for(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    failed = 0
    for k in keys or list(qs):
        t0 = time.time()
        if k not in sqls:
            n = qs[k](spark, sf_dir).count()
            print(f"ROWS  {k:34s} {n} rows ({time.time() - t0:.1f}s)")
            continue
        try:
            ok, msg = compare(spark, con, k, sf_dir, qs[k], sqls[k])
        except Exception as e:  # report and continue
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:400]}"
        failed += not ok
        print(f"{'OK  ' if ok else 'FAIL'}  {k:34s} {msg} ({time.time() - t0:.1f}s)", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
