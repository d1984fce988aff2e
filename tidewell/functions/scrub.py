"""Masking of credentials in text columns, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret key names, database URI schemes and the mask.
SECRET_KEYS = (
    "password", "token", "secret", "api_key", "access_key", "secret_key",
    "aws_access_key_id", "aws_secret_access_key",
)
URI_SCHEMES = ("postgres", "postgresql", "snowflake", "databricks", "redshift")
SUFFIXED_URI_SCHEMES = ("mysql", "mssql")
MASK = "***"

# Unicode white space, spelled out so that every regex engine reads it alike.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

KEY_VALUE = f"(?i)({'|'.join(SECRET_KEYS)})[{SPACE}]*=[{SPACE}]*[^{SPACE}&'\";)]+"
URI_USERINFO = (
    rf"(?i)((?:{'|'.join(URI_SCHEMES)})(?:\+\w+)?|(?:{'|'.join(SUFFIXED_URI_SCHEMES)})\+?\w*)"
    rf"://([^:/{SPACE}]+):[^@{SPACE}]+@"
)


def scrub_key_values(text: Column) -> Column:
    """``password = x`` becomes ``password=***``; texts without ``=`` skip the regex."""
    masked = F.regexp_replace(text, KEY_VALUE, f"$1={MASK}")
    return F.when(F.contains(text, F.lit("=")), masked).otherwise(text)


def scrub_uris(text: Column) -> Column:
    """``postgresql://user:pw@host`` becomes ``postgresql://user:***@host``."""
    masked = F.regexp_replace(text, URI_USERINFO, f"$1://$2:{MASK}@")
    return F.when(F.contains(text, F.lit("://")), masked).otherwise(text)


def scrub(text: Column) -> Column:
    """Both masks, key-value pairs first."""
    return scrub_uris(scrub_key_values(text))
