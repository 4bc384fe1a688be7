"""Compare registered queries with their check SQL in DuckDB.

``python tests/oracle.py [--sf DIR] [name-prefix …]``
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, Decimal):
        return ("decimal", str(value.normalize()))
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else repr(round(value, 6) + 0.0))
    if isinstance(value, datetime.datetime):
        return ("time", value.replace(tzinfo=None).isoformat())
    if isinstance(value, datetime.date):
        return ("date", value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return ("none" if value is None else "str", value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=repr
    )


def compare(spark, con, name, fn, sql, sf_dir):
    """(problem or None, row count, seconds)."""
    started = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return (None if rows else "no rows"), len(rows), seconds
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = canonical(want_columns, cursor.fetchall())
    got = canonical(df.columns, rows)
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(rows), seconds
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(rows), seconds
    different = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if different:
        g, w = different[0]
        cells = [(c, a, b) for c, a, b in zip(got[0], g, w) if a != b]
        return f"{len(different)} rows differ, first: {cells[:6]}", len(rows), seconds
    if not rows:
        return "no rows", 0, seconds
    return None, len(rows), seconds


def main() -> int:
    import __spark_entry__ as e
    from herdspark.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        sf_dir, args = args[1], args[2:]
    spark = local_session()
    con = connect(sf_dir)
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            problem, count, seconds = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem, count, seconds = f"{type(error).__name__}: {str(error)[:900]}", -1, 0.0
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} rows={count} {seconds:.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
