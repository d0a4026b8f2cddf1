"""Object-store addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Schemes in whose keys ``?`` and ``#`` are ordinary characters.
STORES = ("s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cos")
ADDRESS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(.*)$"
WEB = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def part(url: Column, i: int) -> Column:
    """Part ``i`` of an address; NULL for text that is none. Nothing is decoded and nothing fails."""
    store = F.lower(F.regexp_extract(url, ADDRESS, 1)).isin(*STORES)
    return F.when(url.rlike(WEB), F.when(store, F.regexp_extract(url, ADDRESS, i)).otherwise(F.regexp_extract(url, WEB, i)))


def bucket(url: Column) -> Column:
    """The part between ``//`` and the first slash."""
    return part(url, 2)


def object_key(url: Column) -> Column:
    """The path without its leading slashes."""
    return F.ltrim(part(url, 3), F.lit("/"))


def to_s3a(url: Column) -> Column:
    """``s3://`` becomes ``s3a://``; any other scheme, ``s3a://`` included, is kept."""
    return F.regexp_replace(url, "^s3://", "s3a://")
