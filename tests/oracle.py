"""Compare a registered query with its SQL, both over whole tables."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, query, sql: str, sf_dir: str) -> list[str]:
    """Differences, empty if there are none."""
    frame = query(spark, sf_dir)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} against {sorted(names)}"]
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    theirs = rows_of(names, result.fetchall())
    problems = []
    if mine.total() != theirs.total():
        problems.append(f"{mine.total()} rows against {theirs.total()}")
    if mine != theirs:
        problems.append(f"only Spark: {list((mine - theirs).items())[:2]}")
        problems.append(f"only SQL: {list((theirs - mine).items())[:2]}")
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    described = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    names_of = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
                "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}
    for column, kind in described.items():
        if names_of.get(kind, types[column]) != types[column]:
            problems.append(f"type of {column}: {types[column]} against {kind}")
    return problems
