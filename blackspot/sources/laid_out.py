"""Crash tables laid out along a space-filling curve, with a box for every file.

Files hold stretches of the curve, so each covers a small part of the map. The box
of every file goes to a side table; a reader of regions opens only files whose
box meets one of them, and reads within those by row group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blackspot.functions.columns import to_degrees
from blackspot.functions.geo import MICRO, micro, morton
from blackspot.operators.regions import Region

ROWS, BOXES = "rows", "boxes"
# Most boxes that a choice of files is compared with; neighbours of a longer list are put into one box.
MOST_BOXES = 64


def write_laid_out(df: DataFrame, path: str, files: int | None = None, lat: str = "Latitude", lon: str = "Longitude") -> None:
    """``df`` as Parquet below ``path``, range-partitioned along the curve into ``files`` files, and their boxes.

    Without ``files`` adaptive execution chooses their number by size. Rows at one
    place cannot be told apart by the curve, so a hash of the whole row comes
    second in the order and a crowded place is dealt to several files. Rows without
    a position are kept, in files of no region.
    """
    at = lambda c, shift: micro(to_degrees(F.col(c))) + shift * MICRO
    rows = df.withColumns({"_z": morton(at(lon, 180), at(lat, 90)), "_h": F.xxhash64(*df.columns)})
    dealt = rows.repartitionByRange(files, "_z", "_h") if files else rows.repartitionByRange("_z", "_h")
    dealt.sortWithinPartitions("_z", "_h").drop("_z", "_h").write.mode("overwrite").parquet(f"{path}/{ROWS}")
    written = df.sparkSession.read.parquet(f"{path}/{ROWS}")
    sides = [f(to_degrees(F.col(c))).alias(f"{n}_{f.__name__}") for n, c in (("lat", lat), ("lon", lon)) for f in (F.min, F.max)]
    (written.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(*sides, F.count(F.lit(1)).alias("rows"))
     .write.mode("overwrite").parquet(f"{path}/{BOXES}"))


def fewer(regions: list[Region]) -> list[Region]:
    """Boxes that hold all ``regions``, at most ``MOST_BOXES``; neighbours in latitude share one."""
    ranked = sorted(regions, key=lambda r: r[1:])
    size = -(-len(ranked) // MOST_BOXES)
    around = lambda part: Region("", min(r.lat_min for r in part), max(r.lat_max for r in part), min(r.lon_min for r in part), max(r.lon_max for r in part))
    return [around(ranked[i:i + size]) for i in range(0, len(ranked), size)]


def meets(r: Region) -> Column:
    return ((F.col("lat_max") >= r.lat_min) & (F.col("lat_min") <= r.lat_max)
            & (F.col("lon_max") >= r.lon_min) & (F.col("lon_min") <= r.lon_max))


def read_near_regions(spark: SparkSession, path: str, regions: list[Region]) -> DataFrame:
    """The rows of all files of :func:`write_laid_out` that may hold rows of ``regions``.

    Only names of files that are opened come to the driver. The rows still have to
    be cut by region; no region, or none that a file meets, gives no rows.
    """
    whole = spark.read.parquet(f"{path}/{ROWS}")
    if not regions:
        return whole.limit(0)
    near = spark.read.parquet(f"{path}/{BOXES}").filter(reduce(lambda a, b: a | b, map(meets, fewer(regions))))
    names = [f"{path}/{ROWS}/{r['file']}" for r in near.select("file").collect()]
    return spark.read.schema(whole.schema).parquet(*names) if names else whole.limit(0)
