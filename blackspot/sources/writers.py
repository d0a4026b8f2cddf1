"""Writers for centroid tables and for region and year subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_centroids(centroids: DataFrame, path: str) -> None:
    """Centroid table as a directory of CSV part files with headers."""
    centroids.write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, column: str, fmt: str = "parquet") -> None:
    """One sub-directory per value of ``column`` (a region name or a year).

    Rows go to the writers as they lie, so that a region or year holding most of
    the rows is written by many tasks instead of one.
    """
    writer = df.write.mode("overwrite").partitionBy(column)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_markers(markers: DataFrame, path: str) -> None:
    """Marker table as JSON lines, ready for a map; the markers of several ranks go to a sub-directory each."""
    writer = markers.write.mode("overwrite")
    (writer.partitionBy("rank") if "rank" in markers.columns else writer).json(path)
