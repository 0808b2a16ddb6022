"""Run registered queries next to their SQL and compare value by value.

Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _text(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def compare(spark, connection, query, sf_dir):
    """Empty string when equal, else a short description of the difference."""
    frame = query.run(spark, sf_dir)
    ours = rows_of(frame.collect(), frame.columns)
    sql = query.oracle()
    if sql is None:
        return "" if ours else "no rows"
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(cursor.fetchall(), names)
    if sorted(names) != sorted(frame.columns):
        return f"columns {frame.columns} != {names}"
    if ours == theirs:
        return "" if ours else "no rows on both sides"
    only_ours = [r for r in ours if r not in set(theirs)]
    only_theirs = [r for r in theirs if r not in set(ours)]
    return (
        f"{len(ours)} rows vs {len(theirs)}; {len(only_ours)} differ;"
        f" ours {only_ours[:2]} theirs {only_theirs[:2]}"
    )


def main(argv):
    from voltmill.plans import load_queries
    from voltmill.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle-check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(sf_dir)
    queries = load_queries()
    failures = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            problem = compare(spark, connection, queries[name], sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if queries[name].sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem}", flush=True)
        failures += bool(problem)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
