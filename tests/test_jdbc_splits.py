"""Reads of SQL tables in ranges of equal row counts; DuckDB stands in for the database."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal
from types import SimpleNamespace

import duckdb
import pytest

from tidewell.sources.jdbc import bounds_statement, build, split_predicates, sql_literal
from tidewell.spec import Source

RNG = random.Random(5)
KEYS = {
    "VARCHAR": [RNG.choice(["", "o'neil", "a\\b", "Zoë", "tab\there"]) + str(RNG.randrange(90)) for _ in range(700)],
    "BIGINT": [RNG.choice([7, RNG.randrange(-500, 500)]) for _ in range(700)],
    "DATE": [date(2024, 1, 1 + RNG.randrange(28)) for _ in range(300)],
    "TIMESTAMP": [datetime(2024, 1, 1, RNG.randrange(24), 0, 0, RNG.randrange(999)) for _ in range(300)],
    "DECIMAL(9,2)": [Decimal(RNG.randrange(9999)) / 100 for _ in range(300)],
    "DOUBLE": [RNG.random() for _ in range(300)] + [float("nan")] * 40,
}


def table_of(kind, keys):
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE t (n INTEGER, k {kind})")
    duck.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate([*keys, None, None])))
    return duck


def bounds(duck, parts):
    rows = duck.execute(f"SELECT * FROM {bounds_statement('t', 'k', parts)}").fetchall()
    return [bound for _, bound in sorted(rows, key=lambda r: r[0])]


@pytest.mark.parametrize("kind", sorted(KEYS))
@pytest.mark.parametrize("parts", [1, 2, 7, 60])
def test_every_row_lies_in_one_range(kind, parts):
    duck = table_of(kind, KEYS[kind])
    found = []
    for predicate in split_predicates("k", bounds(duck, parts)):
        found += [r[0] for r in duck.execute(f"SELECT n FROM t WHERE {predicate}").fetchall()]
    assert sorted(found) == list(range(len(KEYS[kind]) + 2))


def test_ranges_follow_rows_not_values():
    duck = table_of("BIGINT", [*range(1000), 10**12])
    sizes = [
        duck.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0]
        for p in split_predicates("k", bounds(duck, 10))
    ]
    assert len(sizes) == 10 and max(sizes) <= 105


@pytest.mark.parametrize("keys", [[], [3, 3, 3]])
def test_few_keys(keys):
    duck = table_of("BIGINT", keys)
    where = split_predicates("k", bounds(duck, 4))
    total = sum(duck.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in where)
    assert total == len(keys) + 2


def test_keys_that_cannot_be_written_join_their_ranges():
    assert sql_literal("a\\b") is None and sql_literal(float("inf")) is None
    assert split_predicates("k", ["a", "a\\b", "c", "z"]) == [
        "k <= 'a' OR k IS NULL", "k > 'a' AND k <= 'c'", "k > 'c'",
    ]


def test_statement():
    statement = bounds_statement("raw.orders", "code", 3, 2.5)
    assert "NTILE(3)" in statement and "raw.orders TABLESAMPLE SYSTEM (2.5) WHERE code IS NOT NULL" in statement
    for column, parts, percent in (("a b", 3, None), ("a", 0, None), ("a", 3, 0.0), ("a", 3, 101.0)):
        with pytest.raises(ValueError):
            bounds_statement("t", column, parts, percent)


class Reader:
    """Keeps what was asked of Spark's reader."""

    def __init__(self):
        self.calls = []

    def format(self, name):
        return self

    def options(self, **options):
        self.asked = options
        return self

    def load(self):
        self.calls.append(("load", self.asked))
        return SimpleNamespace(collect=lambda: [(2, "m"), (1, "f"), (3, "t")])

    def jdbc(self, url, table, predicates, properties):
        self.calls.append(("jdbc", url, table, predicates, properties))
        return "split"


def source(**config):
    return Source(type="sql_database", connection="pg", config={"tables": ["orders", "lines"], **config})


def test_tables_are_split_by_their_own_column():
    reader = Reader()
    place = {"pg": {"url": "jdbc:postgresql://h/d", "user": "u"}}
    built = build(
        SimpleNamespace(read=reader),
        source(schema="raw", split_columns={"orders": "code"}, num_partitions=3, chunk_size=50), place,
    )
    assert built["orders"] == "split"
    (_, first), (_, url, table, predicates, properties), (_, plain) = reader.calls
    assert first["dbtable"] == bounds_statement("raw.orders", "code", 3)
    assert (url, table) == ("jdbc:postgresql://h/d", "raw.orders")
    assert predicates == ["code <= 'f' OR code IS NULL", "code > 'f' AND code <= 'm'", "code > 'm'"]
    assert properties == {"user": "u", "fetchsize": "50"}
    assert plain["dbtable"] == "raw.lines" and "numPartitions" not in plain


def test_settings_are_checked():
    for config in ({"split_columns": {"orders": "code"}}, {"split_columns": {"x": "c"}, "num_partitions": 2}):
        with pytest.raises(ValueError, match="split_columns"):
            build(SimpleNamespace(read=Reader()), source(**config), {"pg": {"url": "u"}})
