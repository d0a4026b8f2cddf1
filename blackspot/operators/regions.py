"""Latitude/longitude boxes."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from blackspot.clustering.components import components
from blackspot.functions.columns import to_degrees
from blackspot.joins import split_join
from blackspot.operators.clean import clean_coordinates
from blackspot.runtime import cut, require_columns


class Region(NamedTuple):
    name: str
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


# The four study areas.
STUDY_REGIONS = [
    Region("boerne", 29.7, 29.8, -98.8, -98.6),
    Region("san_antonio", 29.4, 29.45, -98.5, -98.45),
    Region("sugarland", 29.55, 29.65, -95.7, -95.5),
    Region("austin", 30.25, 30.35, -97.73, -97.63),
]

# Boxes with up to this many join cells together are sent to every task; more are joined by shuffles. The rows are the same.
BROADCAST_CELLS = 100_000
# Side of the join cells in degrees.
CELL_DEGREES = 0.5


def filter_region(df: DataFrame, lat_bounds: tuple[float, float], lon_bounds: tuple[float, float],
                  lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """Rows inside the box; all four bounds belong to it.

    A column that already is a double is compared as it is, so that the bounds
    reach the file scan and prune row groups.
    """
    require_columns(df, lat, lon)
    types = dict(df.dtypes)
    column = lambda c: F.col(c) if types[c] == "double" else to_degrees(F.col(c))
    return df.filter(column(lat).between(*lat_bounds) & column(lon).between(*lon_bounds))


def cells_in(regions: list[Region]) -> int:
    """How many join cells the boxes have, each box counted on its own."""
    side = lambda low, high: abs(math.floor(high / CELL_DEGREES) - math.floor(low / CELL_DEGREES)) + 1
    return sum(side(r.lat_min, r.lat_max) * side(r.lon_min, r.lon_max) for r in regions)


def tag_regions(df: DataFrame, regions: list[Region], lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """One output row per row and box that holds it, with the box name in ``region``.

    The box around all boxes is short enough for the scan to use. The boxes
    themselves are cut into cells, which turns the range test into an equality
    join; their list comes from the caller, so its size is known. No boxes give
    no rows.
    """
    df = clean_coordinates(df, lat, lon)
    if not regions:
        return df.withColumn("region", F.lit("")).limit(0)
    df = df.filter(F.col(lat).between(min(r.lat_min for r in regions), max(r.lat_max for r in regions))
                   & F.col(lon).between(min(r.lon_min for r in regions), max(r.lon_max for r in regions)))
    cell = lambda c: F.floor(c / F.lit(CELL_DEGREES))
    boxes = (df.sparkSession.createDataFrame([(r.name, *map(float, r[1:])) for r in regions], "region string, _a double, _b double, _c double, _d double")
             .withColumn("_cy", F.explode(F.sequence(cell(F.col("_a")), cell(F.col("_b")))))
             .withColumn("_cx", F.explode(F.sequence(cell(F.col("_c")), cell(F.col("_d"))))))
    boxes = F.broadcast(boxes) if cells_in(regions) <= BROADCAST_CELLS else boxes
    return (df.withColumns({"_cy": cell(F.col(lat)), "_cx": cell(F.col(lon))})
            .join(boxes, ["_cy", "_cx"])
            .filter(F.col(lat).between(F.col("_a"), F.col("_b")) & F.col(lon).between(F.col("_c"), F.col("_d")))
            .drop("_cy", "_cx", "_a", "_b", "_c", "_d"))


def region_counts(df: DataFrame, regions: list[Region]) -> DataFrame:
    return tag_regions(df, regions).groupBy("region").agg(F.count(F.lit(1)).alias("crashes"))


def with_cells(df: DataFrame, cell_degrees: float, lat: str, lon: str) -> DataFrame:
    """Rows with a position, and their grid cell ``cell_lat, cell_lon``."""
    # Whole micro-degrees keep cell edges exact.
    side = round(cell_degrees * 1_000_000)
    cell = lambda c: F.floor(F.round(F.col(c) * 1e6) / F.lit(side))
    return clean_coordinates(df, lat, lon).withColumns({"cell_lat": cell(lat), "cell_lon": cell(lon)})


def density_split(df: DataFrame, min_crashes: int, cell_degrees: float = 0.1,
                  lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """Mark each row ``urban`` or ``rural`` by the number of crashes in its grid cell.

    Cells are counted before they are joined back, and the rows of a crowded cell
    are dealt to several tasks.
    """
    keyed = with_cells(df, cell_degrees, lat, lon)
    counted = keyed.groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("_n"))
    return (split_join(keyed, counted, ["cell_lat", "cell_lon"], "_n", [lat, lon])
            .withColumn("area", F.when(F.col("_n") >= min_crashes, "urban").otherwise("rural")).drop("_n"))


def joined_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with their area: cells that touch, also at a corner, are one area, named by its first cell.

    Cells are few against rows, and an area may cross the whole map: the links of
    neighbours are joined by equality and their components found in a number of
    rounds that grows with the logarithm of the longest chain.
    """
    node = lambda a, b: F.shiftleft(F.col(a).cast("bigint"), 32) + F.col(b)
    cells = cut(cells.withColumn("_node", node("cell_lat", "cell_lon")))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    beside = (cells.select(F.col("_node").alias("a"), "cell_lat", "cell_lon", F.explode(steps).alias("step"))
              .select("a", (F.col("cell_lat") + F.col("step.a")).alias("cell_lat"), (F.col("cell_lon") + F.col("step.b")).alias("cell_lon")))
    roots = components(beside.join(cells, ["cell_lat", "cell_lon"]).select("a", F.col("_node").alias("b")))
    names = cells.select(F.col("_node").alias("_first"), F.col("cell_lat").alias("area_lat"), F.col("cell_lon").alias("area_lon"))
    return (cells.join(roots, F.col("_node") == F.col("node"), "left").withColumn("_first", F.coalesce("root", "_node"))
            .join(names, "_first").drop("_node", "_first", "node", "root"))


def urban_areas(df: DataFrame, min_crashes: int, cell_degrees: float = 0.1,
                lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """One row per urban area: ``area_lat, area_lon, cells, crashes, deaths, fatality_rate``.

    An area is made of touching cells with at least ``min_crashes`` crashes each
    and named by the first of them. All is summed by cell before cells are joined.
    """
    sums = (with_cells(df, cell_degrees, lat, lon).groupBy("cell_lat", "cell_lon")
            .agg(F.count(F.lit(1)).alias("crashes"), F.sum("Death_Cnt").cast("bigint").alias("deaths"), F.count("Death_Cnt").alias("_counted")))
    return (joined_cells(sums.filter(F.col("crashes") >= min_crashes)).groupBy("area_lat", "area_lon")
            .agg(F.count(F.lit(1)).alias("cells"), F.sum("crashes").alias("crashes"), F.sum("deaths").alias("deaths"),
                 F.try_divide(F.sum("deaths"), F.sum("_counted")).alias("fatality_rate")))


def tag_urban_areas(df: DataFrame, min_crashes: int, cell_degrees: float = 0.1,
                    lat: str = "Latitude", lon: str = "Longitude") -> DataFrame:
    """Rows with a position, and the urban area they lie in (``area_lat, area_lon``, NULL in the country).

    The area can stand as the group of a clustering of its own.
    """
    keyed = with_cells(df, cell_degrees, lat, lon)
    counted = cut(keyed.groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("_n")))
    areas = joined_cells(counted.filter(F.col("_n") >= min_crashes)).drop("_n")
    return split_join(keyed, counted.join(areas, ["cell_lat", "cell_lon"], "left"), ["cell_lat", "cell_lon"], "_n", [lat, lon]).drop("_n")
