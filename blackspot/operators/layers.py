"""Point and centroid layers for a map, in Web Mercator metres."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blackspot.functions.colors import PALETTE_SIZE
from blackspot.functions.geo import point
from blackspot.joins import split_join
from blackspot.operators.clean import extent, web_mercator
from blackspot.operators.neighborhood import normalize_rate
from blackspot.operators.ranking import with_rank
from blackspot.runtime import require_columns

# Fixed value.
BUFFER_RATIO = 0.1


def categorical_slots(df: DataFrame, label: str) -> DataFrame:
    """One row per label with its palette slot: labels in order take the colours in turn."""
    return counted_slots(df, label).select(label, "slot")


def counted_slots(df: DataFrame, label: str) -> DataFrame:
    """The slots with the number of rows of each label."""
    labels = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return (with_rank(labels, label, name="_code")
            .select(label, "_n", F.pmod(F.col("_code") - 1, F.lit(PALETTE_SIZE)).cast("int").alias("slot")))


def cluster_layer(points: DataFrame, label: str) -> DataFrame:
    """Every crash with its projected position, cluster label and palette slot."""
    require_columns(points, "Crash_ID", "Latitude", "Longitude", label)
    return (split_join(web_mercator(points), counted_slots(points, label), [label], "_n", "Crash_ID")
            .withColumn("geometry", point(F.col("Latitude"), F.col("Longitude")))
            .select("Crash_ID", "geometry", "x", "y", label, "slot"))


def centroid_layer(centroids: DataFrame, cluster_col: str, buffer_ratio: float = BUFFER_RATIO) -> DataFrame:
    """Every centroid with its projected position, its rate scaled over all centroids and the map bounds."""
    require_columns(centroids, cluster_col, "centroid_latitude", "centroid_longitude", "fatality_rate")
    placed = web_mercator(centroids, "centroid_latitude", "centroid_longitude")
    bounds = extent(placed, buffer_ratio).select(F.struct("*").alias("bounds")).scalar()
    return (normalize_rate(placed).withColumn("_b", bounds)
            .select(cluster_col, "x", "y", "fatality_rate", "color_value",
                    "_b.min_x", "_b.max_x", "_b.min_y", "_b.max_y"))
