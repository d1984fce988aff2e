"""Nested data into flat tables, and paged JSON into records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "__"
ROW_ID = "_row_id"


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found: list[tuple[str, ...]] = []
    for field in schema:
        here = (*path, field.name)
        nested = isinstance(field.dataType, T.StructType)
        found += _leaves(field.dataType, here) if nested else [here]
    return found


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested fields as columns named ``outer__inner``; one projection, no shuffle."""
    return df.select(
        *[
            F.col(".".join(f"`{part}`" for part in path)).alias(SEPARATOR.join(path))
            for path in _leaves(df.schema)
        ]
    )


def child_table(
    df: DataFrame, parent_key: Sequence[str], array: str, pos: str = "_pos",
    keep_empty: bool = False,
) -> DataFrame:
    """Array elements as rows with the parent's key and their position. With ``keep_empty``
    a parent without elements gives one row without a position."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    exploded = df.select(*parent_key, explode(array).alias(pos, "value"))
    if isinstance(df.schema[array].dataType.elementType, T.StructType):
        return flatten_struct(exploded.select(*parent_key, pos, "value.*"))
    return exploded


def arrays_of(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]


def with_row_id(df: DataFrame) -> DataFrame:
    """A key for rows that have none: a digest of the row, the same in every retry."""
    return df.withColumn(ROW_ID, F.sha2(F.to_json(F.struct(*df.columns)), 256))


@dataclass(frozen=True)
class Child:
    """A table of array elements: its rows, the root's key and its own position columns."""

    rows: DataFrame
    parent_key: list[str]
    positions: list[str]


def split_nested(
    table: str, df: DataFrame, key: Sequence[str], keep_empty: bool = False
) -> tuple[DataFrame, dict[str, Child]]:
    """A nested table as a flat one and one child table per array, ``table__array``; arrays in
    arrays give children of children, linked by the key and the positions on the way."""
    flat = flatten_struct(df)
    arrays = arrays_of(flat)
    if not arrays:
        return flat, {}
    keyed = flat if key else with_row_id(flat)
    root = list(key) or [ROW_ID]
    children: dict[str, Child] = {}

    def descend(name: str, parent: DataFrame, positions: list[str]) -> None:
        for array in arrays_of(parent):
            pos = "_pos" if not positions else f"_pos{len(positions) + 1}"
            rows = child_table(parent, [*root, *positions], array, pos, keep_empty)
            here = [*positions, pos]
            child = f"{name}{SEPARATOR}{array}"
            children[child] = Child(rows.drop(*arrays_of(rows)), root, here)
            descend(child, rows, here)

    descend(table, keyed, [])
    return keyed.drop(*arrays), children


def json_schema(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The schema that JSON texts of a column share, folded in one aggregate."""
    parsed = F.try_parse_json(F.col(column))
    return df.groupBy(*by).agg(F.schema_of_variant_agg(parsed).alias("json_schema"))


def _fractions_as_double(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        fields = [T.StructField(f.name, _fractions_as_double(f.dataType)) for f in dtype]
        return T.StructType(fields)
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_fractions_as_double(dtype.elementType))
    return T.DoubleType() if isinstance(dtype, T.DecimalType) and dtype.scale > 0 else dtype


def infer_json_type(df: DataFrame, column: str) -> T.DataType:
    """The type to parse a JSON text column with; only one schema text reaches the driver.
    Fractions become double, as in Spark's JSON reader, not the decimals of this sample."""
    ddl = json_schema(df, column).first()["json_schema"].replace("OBJECT<", "STRUCT<")
    return _fractions_as_double(T._parse_datatype_string(ddl))


def records_of_pages(
    pages: DataFrame, page_schema: str | T.StructType, records: str = "results",
    payload: str = "payload", carry: Sequence[str] = ("endpoint", "page_no"), strict: bool = False,
) -> DataFrame:
    """One row per record of the page payloads; empty pages give none.

    A page that is no JSON gives none either (``page_report`` counts these); if ``strict``, it
    stops the job and names the page.
    """
    text = F.col(payload)
    if strict:
        place = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("endpoint", "page_no") if c in pages.columns])
        broken = F.raise_error(F.concat(F.lit("page is no JSON: "), place)).cast("string")
        text = F.when(unreadable(text), broken).otherwise(text)
    parsed = F.from_json(text, page_schema)
    return pages.select(*carry, F.inline(parsed.getField(records)))


def unreadable(payload: Column) -> Column:
    """Whether a payload is there, but no JSON."""
    return payload.isNotNull() & F.try_parse_json(payload).isNull()


def page_report(
    pages: DataFrame, page_schema: str | T.StructType, records: str = "results", payload: str = "payload"
) -> DataFrame:
    """Per endpoint: n_pages, n_unreadable (no JSON), n_without_records and n_records."""
    text = F.col(payload)
    size = F.size(F.from_json(text, page_schema).getField(records))
    found = F.coalesce(F.when(size >= 0, size), F.lit(0))
    return pages.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(text.isNull() | unreadable(text)).alias("n_unreadable"),
        F.count_if(~(text.isNull() | unreadable(text)) & (found == 0)).alias("n_without_records"),
        F.sum(found).cast("long").alias("n_records"),
    )


def limit_pages(pages: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pages of every endpoint, cut before the records are unpacked."""
    return pages.filter(F.col("page_no") < n)
