"""Cluster sizes, centroids and deaths per crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blackspot.functions.columns import exact_mean
from blackspot.runtime import require_columns

# Fixed value.
CRASHES_PER_CLUSTER = 250


def cluster_count(df: DataFrame, per_cluster: int = CRASHES_PER_CLUSTER) -> DataFrame:
    """One row: number of crashes and the number of clusters to look for (at least 1)."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("crashes"),
                  F.greatest(F.floor(n / F.lit(per_cluster)), F.lit(1).cast("bigint")).alias("clusters"))


def fatality_rate(df: DataFrame, cluster_col: str, with_size: bool = False) -> DataFrame:
    """Centroid and deaths per crash of every cluster.

    A crash without a death count is left out of both sides of the rate; a
    cluster with none gets a NULL rate.
    """
    require_columns(df, cluster_col, "Latitude", "Longitude", "Death_Cnt")
    aggs = [exact_mean(F.col("Latitude")).alias("centroid_latitude"),
            exact_mean(F.col("Longitude")).alias("centroid_longitude"),
            F.try_divide(F.sum("Death_Cnt"), F.count("Death_Cnt")).alias("fatality_rate")]
    if with_size:
        aggs.append(F.count(F.lit(1)).alias("crashes"))
    return df.groupBy(cluster_col).agg(*aggs)
