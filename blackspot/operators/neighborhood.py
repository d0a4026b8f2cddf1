"""Surroundings of a ranked cluster, as a table ready for a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blackspot.functions.colors import green_red_hex
from blackspot.functions.columns import min_max_scale
from blackspot.functions.geo import MILES_PER_DEGREE, haversine_miles, planar_miles
from blackspot.joins import split_join
from blackspot.operators.ranking import nth_cluster, rank_clusters
from blackspot.runtime import require_columns

# Fixed values.
MARKER_RADIUS = 5
MARKER_OPACITY = 0.7
MAP_ZOOM = 14


def radius_neighbors(centroids: DataFrame, cluster_col: str, rank: int, miles: float,
                     great_circle: bool = False) -> DataFrame:
    """Clusters within ``miles`` of the ``rank``-th worst one, itself included.

    The focus enters the plan as a scalar subquery: nothing is collected and no
    join is needed.
    """
    require_columns(centroids, cluster_col, "centroid_latitude", "centroid_longitude", "fatality_rate")
    focus = (nth_cluster(centroids, cluster_col, rank)
             .select(F.struct("centroid_latitude", "centroid_longitude").alias("focus")).scalar())
    measure = haversine_miles if great_circle else planar_miles
    distance = measure(F.col("centroid_latitude"), F.col("centroid_longitude"),
                       F.col("_focus.centroid_latitude"), F.col("_focus.centroid_longitude"))
    return (centroids.withColumn("_focus", focus).withColumn("distance", distance)
            .filter(F.col("distance") <= F.lit(float(miles))).drop("_focus"))


def normalize_rate(df: DataFrame) -> DataFrame:
    """Add ``color_value``: the rate scaled to 0..1 over the rows of ``df``.

    NULL when all rates are equal. The two bounds come from an ordinary
    aggregate used as a scalar subquery.
    """
    require_columns(df, "fatality_rate")
    rate = F.when(~F.isnan("fatality_rate"), F.col("fatality_rate"))
    bounds = df.agg(F.struct(F.min(rate).alias("low"), F.max(rate).alias("high")).alias("bounds")).scalar()
    return (df.withColumn("_b", bounds)
            .withColumn("color_value", min_max_scale(rate, F.col("_b.low"), F.col("_b.high"))).drop("_b"))


def with_color(df: DataFrame) -> DataFrame:
    return df.withColumn("color_hex", green_red_hex(F.col("color_value")))


def marker_table(centroids: DataFrame, cluster_col: str, rank: int, miles: float,
                 great_circle: bool = False) -> DataFrame:
    """The neighbourhood of the ``rank``-th worst cluster with colours and marker settings."""
    near = radius_neighbors(centroids, cluster_col, rank, miles, great_circle)
    return with_color(normalize_rate(near)).select(
        cluster_col, "centroid_latitude", "centroid_longitude", "fatality_rate", "distance",
        "color_value", "color_hex", F.lit(MARKER_RADIUS).alias("radius"),
        F.lit(MARKER_OPACITY).alias("fill_opacity"), F.lit(MAP_ZOOM).alias("zoom"))


def radius_neighbors_of_ranks(centroids: DataFrame, cluster_col: str, first: int, last: int, miles: float) -> DataFrame:
    """Clusters within ``miles`` of each of the worst ones from rank ``first`` to ``last``: one row per ``rank`` and neighbour.

    A grid whose cells are as wide as the radius makes the range join one on
    equal cells: a focus looks into its own cell and the eight around it.
    """
    require_columns(centroids, cluster_col, "centroid_latitude", "centroid_longitude", "fatality_rate")
    if not 1 <= first <= last:
        raise ValueError("ranks count from 1")
    # A little wider than the radius, so that rounding cannot lose a neighbour on its edge.
    side = max(miles / MILES_PER_DEGREE * (1 + 1e-9), 1e-6)
    cell = lambda c: F.floor(F.col(c) / F.lit(side))
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    focus = (rank_clusters(centroids, cluster_col).filter(F.col("rank").between(first, last))
             .select("rank", F.col("centroid_latitude").alias("_lat"), F.col("centroid_longitude").alias("_lon"))
             .withColumn("_a", around("_lat")).withColumn("_b", around("_lon")))
    held = centroids.withColumns({"_a": cell("centroid_latitude"), "_b": cell("centroid_longitude")})
    distance = planar_miles(F.col("centroid_latitude"), F.col("centroid_longitude"), F.col("_lat"), F.col("_lon"))
    return (held.join(focus, ["_a", "_b"]).withColumn("distance", distance).filter(F.col("distance") <= F.lit(float(miles)))
            .drop("_a", "_b", "_lat", "_lon"))


def marker_table_ranks(centroids: DataFrame, cluster_col: str, first: int, last: int, miles: float) -> DataFrame:
    """``marker_table`` for all ranks from ``first`` to ``last`` in one go, with the column ``rank``; colours span each neighbourhood."""
    near = radius_neighbors_of_ranks(centroids, cluster_col, first, last, miles)
    rate = F.when(~F.isnan("fatality_rate"), F.col("fatality_rate"))
    bounds = near.groupBy("rank").agg(F.min(rate).alias("_low"), F.max(rate).alias("_high"), F.count(F.lit(1)).alias("_n"))
    scaled = split_join(near, bounds, ["rank"], "_n", cluster_col).withColumn("color_value", min_max_scale(rate, F.col("_low"), F.col("_high")))
    return with_color(scaled).select(
        "rank", cluster_col, "centroid_latitude", "centroid_longitude", "fatality_rate", "distance",
        "color_value", "color_hex", F.lit(MARKER_RADIUS).alias("radius"),
        F.lit(MARKER_OPACITY).alias("fill_opacity"), F.lit(MAP_ZOOM).alias("zoom"))
