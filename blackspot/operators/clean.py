"""Projection, coordinate clean-up, date parsing and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blackspot.functions.columns import to_date, to_degrees
from blackspot.functions.geo import mercator_x, mercator_y
from blackspot.runtime import require_columns
from blackspot.sources.schema import CRASH_COLUMNS


def project_crashes(df: DataFrame) -> DataFrame:
    """Keep the twelve crash columns."""
    require_columns(df, *CRASH_COLUMNS)
    return df.select(*CRASH_COLUMNS)


def clean_coordinates(df: DataFrame, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """Coordinates as doubles, without the rows that lack one of them (NULL, NaN or infinite).

    A column that already is a double stays a plain column, so that filters on it
    reach the file scan. Parsed ones pass through ``inline``, since a filter on them
    would be pushed below and parse again, several times in a row, in code too long to be compiled.
    """
    require_columns(df, lat, lon)
    types = dict(df.dtypes)
    parsed = {c: to_degrees(F.col(c)) for c in (lat, lon) if types[c] != "double"}
    finite = (F.abs(F.col(lat)) < float("inf")) & (F.abs(F.col(lon)) < float("inf"))
    if parsed:
        named = {c: f"_parsed_{i}" for i, c in enumerate(parsed)}
        rows = df.select("*", F.inline(F.array(F.struct(*[parsed[c].alias(n) for c, n in named.items()]))))
        df = rows.select(*[F.col(named[c]).alias(c) if c in named else F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
    return df.dropna(subset=[lat, lon]).filter(finite)


def parse_dates(df: DataFrame, column: str = "Crash_Date") -> DataFrame:
    require_columns(df, column)
    return df.withColumn(column, to_date(F.col(column)))


def filter_year(df: DataFrame, year: int, column: str = "Crash_Date") -> DataFrame:
    """Rows of one calendar year, with the date column parsed."""
    return parse_dates(df, column).filter(F.year(column) == year)


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type and number of non-null values; one pass over the data."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type"),
                        F.col(n).alias("non_null")) for n, t in df.dtypes]
    return counts.select(F.inline(F.array(*entries)))


def web_mercator(df: DataFrame, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """Add ``x`` and ``y`` in metres."""
    require_columns(df, lat, lon)
    return df.withColumns({"x": mercator_x(F.col(lon)), "y": mercator_y(F.col(lat))})


def extent(df: DataFrame, buffer_ratio: float = 0.0) -> DataFrame:
    """One row with the bounds of ``x`` and ``y``, widened on each side by a share of the span."""
    lo_x, hi_x, lo_y, hi_y = F.min("x"), F.max("x"), F.min("y"), F.max("y")
    bx, by = (hi_x - lo_x) * F.lit(buffer_ratio), (hi_y - lo_y) * F.lit(buffer_ratio)
    return df.agg((lo_x - bx).alias("min_x"), (hi_x + bx).alias("max_x"),
                  (lo_y - by).alias("min_y"), (hi_y + by).alias("max_y"))
