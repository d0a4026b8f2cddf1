"""Crash rows as whole-number map positions, and distinct positions with weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from blackspot.functions.geo import MICRO, micro, morton
from blackspot.joins import split_join
from blackspot.operators.clean import clean_coordinates
from blackspot.runtime import cut

# Offsets that make every coordinate non-negative.
X_SHIFT = 180 * MICRO
Y_SHIFT = 90 * MICRO


def place(df: DataFrame, lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """Drop rows without a position and add ``x`` and ``y`` in whole micro-degrees."""
    return (clean_coordinates(df, lat, lon)
            .withColumns({"x": micro(F.col(lon)) + X_SHIFT, "y": micro(F.col(lat)) + Y_SHIFT}))


def positions(placed: DataFrame, *aggs: Column) -> DataFrame:
    """Distinct positions with their number of rows ``w`` and Z-order code ``z``.

    The partial aggregation runs before the shuffle, so a position that holds a
    third of all rows costs one row per task.
    """
    return (placed.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"), *aggs)
            .withColumn("z", morton(F.col("x"), F.col("y"))))


def label_rows(placed: DataFrame, labels: DataFrame, label: str, default: int | None = None, keys: list[str] = ["x", "y"]) -> DataFrame:
    """Give every crash the label of its position and drop the helper columns.

    ``labels`` has one row per position, or for every combination of ``keys``. The rows of a crowded position are dealt
    to several tasks. The numbers of rows are written once, since they are read three times.
    """
    crowds = cut(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(labels.select(*keys, label), keys, "left"))
    joined = split_join(placed, crowds, keys, "_n", "Crash_ID").drop("_n", *keys)
    if default is None:
        return joined.filter(F.col(label).isNotNull())
    return joined.withColumn(label, F.coalesce(F.col(label), F.lit(default).cast("bigint")))
