"""Tables and views of SQL databases over JDBC."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.registry import Connections, check_keys, register
from tidewell.spec import Source

# Config keys, back ends and reflection levels that specs may name.
CONFIG_KEYS = frozenset(
    {
        "schema", "tables", "backend", "chunk_size", "include_views", "reflection_level",
        "defer_table_reflect", "partition_column", "lower_bound", "upper_bound", "num_partitions",
        "custom_schema", "split_columns", "split_sample_percent",
    }
)
BACKENDS = ("sqlalchemy", "pyarrow", "pandas", "connectorx")
REFLECTION_LEVELS = ("minimal", "full", "full_with_precision")

_SPLIT_KEYS = {
    "partition_column": "partitionColumn", "lower_bound": "lowerBound",
    "upper_bound": "upperBound", "num_partitions": "numPartitions",
}


def reader_options(
    source: Source, table: str, connection: Mapping[str, Any]
) -> dict[str, str]:
    """Spark's JDBC options for one table. With the four split keys the table is read by
    ``num_partitions`` tasks over equally wide ranges of ``partition_column``; a table named in
    ``split_columns`` by as many over ranges of equal row counts, also of text; others by one."""
    config = source.config
    options = {str(k): str(v) for k, v in connection.items()}
    schema = config.get("schema")
    options["dbtable"] = f"{schema}.{table}" if schema else table
    if config.get("chunk_size"):
        options["fetchsize"] = str(config["chunk_size"])
    by_quantile = table in (config.get("split_columns") or {})
    given = [] if by_quantile else [k for k in _SPLIT_KEYS if config.get(k) is not None]
    if given == ["num_partitions"] and config.get("split_columns"):
        given = []  # meant for the tables named there
    if given and len(given) < len(_SPLIT_KEYS):
        raise ValueError(f"sql_database source {source.connection!r}: {sorted(_SPLIT_KEYS)} go together")
    options.update({_SPLIT_KEYS[k]: str(config[k]) for k in given})
    custom = (config.get("custom_schema") or {}).get(table)
    if custom and config.get("reflection_level", "full") == "full_with_precision":
        options["customSchema"] = custom
    return options


def check_config(source: Source) -> None:
    check_keys(source, CONFIG_KEYS)
    label = f"sql_database source {source.connection!r}"
    if not source.config.get("tables"):
        raise ValueError(f"{label} needs config.tables with at least one name")
    split = source.config.get("split_columns") or {}
    strange = sorted(set(split) - set(source.config["tables"]))
    if strange:
        raise ValueError(f"{label}: split_columns names {strange}, which are not in config.tables")
    if split and source.config.get("num_partitions") is None:
        raise ValueError(f"{label}: split_columns needs num_partitions")
    # Spark always extracts in columns, so the back end is accepted and has no effect.
    for key, allowed in (("backend", BACKENDS), ("reflection_level", REFLECTION_LEVELS)):
        value = source.config.get(key)
        if value is not None and value not in allowed:
            raise ValueError(f"{label}: {key} must be one of {list(allowed)}, got {value!r}")


def bounds_statement(
    table: str, column: str, parts: int, sample_percent: float | None = None
) -> str:
    """A subquery of the largest key in each of ``parts`` equal shares of a table's rows, with the
    share's number, in the database's own order of the keys (text too). From a sample of the
    table's pages if asked for; that makes shares less even, and misses no row."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*", column):
        raise ValueError(f"split column {column!r} is no plain identifier")
    if parts < 1:
        raise ValueError(f"num_partitions must be at least 1, got {parts}")
    sample = ""
    if sample_percent is not None:
        if not 0 < sample_percent <= 100:
            raise ValueError(f"split_sample_percent must be in (0, 100], got {sample_percent}")
        sample = f" TABLESAMPLE SYSTEM ({sample_percent:g})"
    return (
        f"(SELECT share, MAX({column}) AS bound FROM (SELECT {column}, NTILE({parts}) OVER "
        f"(ORDER BY {column}) AS share FROM {table}{sample} WHERE {column} IS NOT NULL) ranked "
        "GROUP BY share) bounds"
    )


def sql_literal(value: Any) -> str | None:
    """A key as an SQL constant; None for one that databases write in different ways."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, Decimal)):
        return str(value) if Decimal(value).is_finite() else None
    if isinstance(value, float):
        return repr(value) if math.isfinite(value) else None
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'" if value.tzinfo is None else None
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str) and value.isprintable() and "\\" not in value:
        return "'" + value.replace("'", "''") + "'"
    return None


def split_predicates(column: str, bounds: Sequence[Any]) -> list[str]:
    """Ranges of a key that cover every row once, those without a key with the first.

    ``bounds`` are the largest keys of the shares in the database's order. Equal ones count once,
    the last one closes nothing, and one that cannot be written joins its range with the next.
    """
    literals = [sql_literal(bound) for bound in bounds[:-1]]
    cuts = list(dict.fromkeys(c for c in literals if c is not None))
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} > {low} AND {column} <= {high}" for low, high in zip(cuts, cuts[1:])]
    return [f"{column} <= {cuts[0]} OR {column} IS NULL", *inner, f"{column} > {cuts[-1]}"]


def _read_table(spark: SparkSession, source: Source, table: str, connection: Mapping[str, Any]) -> DataFrame:
    """Tables with a split column first ask the database for the bounds, which is one statement."""
    options = reader_options(source, table, connection)
    column = (source.config.get("split_columns") or {}).get(table)
    if column is None:
        return spark.read.format("jdbc").options(**options).load()
    percent = source.config.get("split_sample_percent")
    statement = bounds_statement(
        options["dbtable"], column, int(source.config["num_partitions"]),
        None if percent is None else float(percent),
    )
    asked = {**options, "dbtable": statement}
    asked.pop("customSchema", None)  # names columns of the table
    shares = spark.read.format("jdbc").options(**asked)
    # One row per task of the read that follows.
    rows = sorted((tuple(r) for r in shares.load().collect()), key=lambda r: r[0])
    properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(
        options["url"], options["dbtable"], predicates=split_predicates(column, [r[1] for r in rows]),
        properties=properties,
    )


@register("sql_database")
def build(spark: SparkSession, source: Source, connections: Connections) -> dict[str, DataFrame]:
    """Tables and views of a SQL database, one lazy frame each; filters reach its WHERE clause."""
    check_config(source)
    if source.connection not in connections:
        raise ValueError(
            f"sql_database source {source.connection!r}: connections must have an entry for it "
            "with url, user and password"
        )
    connection = connections[source.connection]
    return {
        table: _read_table(spark, source, table, connection) for table in source.config["tables"]
    }
