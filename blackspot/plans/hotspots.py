"""Whole jobs: crash table in, ranked dangerous clusters out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from blackspot.clustering.dbscan import EPS_DEGREES, MIN_SAMPLES, NOISE, dbscan
from blackspot.clustering.kmeans import MAX_ITER, TOLERANCE_DEGREES, kmeans, kmeans_with_status
from blackspot.operators.neighborhood import marker_table_ranks
from blackspot.operators.rates import CRASHES_PER_CLUSTER, fatality_rate
from blackspot.operators.ranking import rank_clusters, rate_order, with_rank
from blackspot.operators.regions import density_split
from blackspot.runtime import cut
from blackspot.sources.readers import read_crashes, read_csv_directory
from blackspot.sources.schema import centroid_schema
from blackspot.sources.writers import write_centroids, write_markers

CLUSTER = "kmeans_cluster"


def cluster_rates(crashes: DataFrame, per_cluster: int = CRASHES_PER_CLUSTER, max_iter: int = MAX_ITER,
                  tolerance: float = TOLERANCE_DEGREES) -> DataFrame:
    """K-means clusters of all crashes with centroid, deaths per crash and size.

    ``converged`` says whether the centres came to rest within ``max_iter`` rounds.
    """
    rows, settled = kmeans_with_status(crashes, per_cluster, max_iter, tolerance, CLUSTER)
    return fatality_rate(rows, CLUSTER, with_size=True).withColumn("converged", F.lit(settled))


def urban_rural_hotspots(crashes: DataFrame, urban_crashes: int, eps: float = EPS_DEGREES, min_samples: int = MIN_SAMPLES,
                         per_cluster: int = CRASHES_PER_CLUSTER, max_iter: int = MAX_ITER,
                         tolerance: float = TOLERANCE_DEGREES) -> DataFrame:
    """Clusters of crowded areas by density and of the others by k-means, rated and ranked together.

    A grid cell with at least ``urban_crashes`` crashes is urban. Urban crashes
    that belong to no cluster are left out.
    """
    split = cut(density_split(crashes, urban_crashes).drop("cell_lat", "cell_lon"))
    urban = dbscan(split.filter("area = 'urban'"), eps, min_samples, "cluster").filter(F.col("cluster") != NOISE)
    rural = kmeans(split.filter("area = 'rural'"), per_cluster, max_iter, tolerance, "cluster")
    rated = [fatality_rate(rows, "cluster", with_size=True).withColumn("area", F.lit(area))
             for rows, area in ((urban, "urban"), (rural, "rural"))]
    both = rated[0].unionByName(rated[1])
    return with_rank(both, rate_order("cluster")[0], "area", "cluster")


def ranked_hotspots(crashes: DataFrame, min_crashes: int = 0, **settings) -> DataFrame:
    """Clusters numbered from the most deaths per crash down."""
    return rank_clusters(cluster_rates(crashes, **settings), CLUSTER, min_crashes)


def run_batch(spark: SparkSession, crash_path: str, centroid_path: str) -> None:
    """Crash CSV to centroid CSV: load, cluster, rate, write."""
    write_centroids(cluster_rates(read_crashes(spark, crash_path)).drop("crashes", "converged"), centroid_path)


def run_evaluation(spark: SparkSession, centroid_path: str, out_path: str, ranks: range = range(1, 6), miles: float = 50) -> None:
    """Centroid CSV files to one marker table per rank, all of them by one job."""
    centroids = read_csv_directory(spark, centroid_path, centroid_schema(CLUSTER))
    markers = marker_table_ranks(centroids, CLUSTER, min(ranks), max(ranks), miles)
    write_markers(markers.filter(F.col("rank").isin(list(ranks))) if ranks.step != 1 else markers, out_path)
