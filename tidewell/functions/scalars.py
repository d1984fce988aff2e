"""Small column functions: identifiers, timestamps, log positions, JSON, routing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The identifier format and the summary length.
IDENTIFIER_PATTERN = r"^[a-z][a-z0-9_]*\z"
SUMMARY_CHARS = 500

_ZONE_PATTERN = r"(?i)(Z|[+-]\d\d:?\d\d)$"


def is_identifier(text: Column) -> Column:
    """True for lower-case names that are safe as table or dataset names."""
    return text.rlike(IDENTIFIER_PATTERN)


def normalize_identifier(text: Column) -> Column:
    """A name turned into an identifier: lower case, other characters become ``_``."""
    cleaned = F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_")
    return F.when(cleaned.rlike("^[a-z]"), cleaned).otherwise(F.concat(F.lit("c_"), cleaned))


def zoned_timestamp(text: Column) -> Column:
    """The instant of a text that names its zone; NULL for naive or broken text."""
    return F.when(text.rlike(_ZONE_PATTERN), F.try_to_timestamp(text))


def lsn_to_number(lsn: Column) -> Column:
    """A log position ``X/Y`` in hex as one exact number, ``X * 2^32 + Y``."""
    high, low = (
        F.conv(F.split_part(lsn, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
        for i in (1, 2)
    )
    return (high * F.lit(2**32).cast("decimal(10,0)") + low).cast("decimal(20,0)")


def lsn_diff(newer: Column, older: Column) -> Column:
    """Bytes between two log positions."""
    return (lsn_to_number(newer) - lsn_to_number(older)).cast("bigint")


def truncate_summary(text: Column, chars: int = SUMMARY_CHARS) -> Column:
    return F.substring(text, 1, chars)


def _json_value(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda v: _json_value(v, dtype.elementType))
        listed = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
        return F.coalesce(listed, F.lit("null"))
    rendered = F.to_json(F.array(value))
    return F.substring(rendered, F.lit(2), F.length(rendered) - 2)


def sorted_json(fields: Mapping[str, tuple[Column, T.DataType]]) -> Column:
    """One JSON object per row: keys in name order, ``", "`` and ``": "`` as separators."""
    pairs = [
        F.concat(F.lit(f'"{name}": '), _json_value(*fields[name])) for name in sorted(fields)
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def route(override: Column, severity: Column, channels: Mapping[str, str]) -> Column:
    """The row's own channel, else the severity's, else NULL; empty texts count as unset."""
    mapped = F.lit(None).cast("string")
    for name, channel in channels.items():
        mapped = F.when(severity == name, F.lit(channel)).otherwise(mapped)
    return F.coalesce(F.nullif(override, F.lit("")), F.nullif(mapped, F.lit("")))
