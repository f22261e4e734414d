"""Runs a registered query and its SQL twin on the same tables and compares all rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.10g}"
    if isinstance(value, datetime):
        return value.isoformat()
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql, sf) -> str | None:
    """None if equal, else what differs."""
    frame = query(spark, sf)
    got = frame.collect()
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    kinds = {c[0]: str(c[1]) for c in answer.description}
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    kind_of = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for name, kind in frame.dtypes:
        if kind in kind_of and kinds[name] != kind_of[kind]:
            return f"type of {name}: {kind} != {kinds[name]}"
    ours, theirs = _bag(frame.columns, got), _bag(names, answer.fetchall())
    if ours == theirs:
        return None
    return f"{len(got)} rows; only ours {list((ours - theirs).items())[:2]}; only SQL {list((theirs - ours).items())[:2]}"


def main(sf: str, names: list[str]) -> int:
    from moodtide.plans import registry
    from moodtide.session import build_session

    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(sf), 0
    sql = registry.all_sql()
    for name, query in registry.all_queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            found = compare(spark, con, query, sql[name], sf) if name in sql else None
            note = "" if name in sql else f" rows only: {query(spark, sf).count()}"
        except Exception as problem:
            found, note = f"{type(problem).__name__}: {str(problem)[:700]}", ""
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - began:.1f}s{note} {found or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
