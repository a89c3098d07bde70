"""Run registered queries beside their SQL and compare names, rows and values.

    python -m catalog.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from catalog import registry
from massmap.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(plain(item) for item in value)
    if hasattr(value, "asDict"):
        return tuple(plain(item) for item in value)
    if isinstance(value, dict):
        return tuple(plain(item) for item in value.values())
    if hasattr(value, "quantize"):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted((tuple(plain(row[at]) for at in order) for row in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    query, sql = registry.QUERIES[name], registry.ORACLES.get(name)
    started = time.time()
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    took = time.time() - started
    if sql is None:
        return f"rows {len(got)} in {took:.1f}s (no SQL)"
    started = time.time()
    cursor = con.execute(sql)
    columns = [entry[0] for entry in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    sql_took = time.time() - started
    if sorted(columns) != sorted(frame.columns):
        return f"FAIL columns {sorted(frame.columns)} / {sorted(columns)}"
    if got != expected:
        only = [row for row in got if row not in set(expected)][:3] if len(got) < 20000 else []
        missing = [row for row in expected if row not in set(got)][:3] if len(got) < 20000 else []
        return f"FAIL {len(got)} / {len(expected)} rows\n    spark {str(only)[:900]}\n    sql   {str(missing)[:900]}"
    return f"ok {len(got)} in {took:.1f}s (SQL {sql_took:.1f}s)"


def main(arguments: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in arguments:
        at = arguments.index("--sf")
        sf_dir = arguments[at + 1]
        arguments = arguments[:at] + arguments[at + 2:]
    names = [n for n in registry.QUERIES if not arguments or any(n == a or n.startswith(a) for a in arguments)]
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    failed = 0
    for name in names:
        try:
            outcome = compare(spark, con, sf_dir, name)
        except Exception as problem:  # noqa: BLE001 - the check goes on to the next query
            outcome = f"FAIL {type(problem).__name__}: {str(problem)[:700]}"
        failed += outcome.startswith("FAIL")
        print(f"{name}: {outcome}", flush=True)
    print(f"{len(names)} queries, {failed} failed", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
