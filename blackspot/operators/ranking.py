"""Global order, numbering and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from blackspot.runtime import cut, require_columns

# Bits below the partition number in monotonically_increasing_id().
ROW_BITS = 33
# Above this rank the whole table is numbered; below it a top-n is cheaper.
TOP_N = 10_000


def sorted_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` range-partitioned and sorted, with ``_row`` increasing along the order.

    The result is materialised, so that partition numbers cannot change when a
    lost task is run again.
    """
    return cut(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))


def part_offsets(rows: DataFrame, amount: Column) -> DataFrame:
    """Per partition of :func:`sorted_rows`: the sum of ``amount`` over all earlier partitions.

    One row per shuffle partition, whatever the data size.
    """
    sums = rows.groupBy(F.shiftright("_row", ROW_BITS).alias("_part")).agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("bigint").alias("_before"))


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Number all rows 1, 2, ... in a total order."""
    rows = sorted_rows(df, *order)
    offsets = part_offsets(rows, F.lit(1))
    in_part = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (rows.withColumn("_part", F.shiftright("_row", ROW_BITS))
            .join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + in_part + 1)
            .drop("_part", "_before", "_row"))


def rate_order(cluster_col: str) -> list[Column]:
    """Highest rate first, clusters without a rate last, ties by cluster label."""
    rate = F.when(~F.isnan("fatality_rate"), F.col("fatality_rate"))
    return [rate.desc_nulls_last(), F.col(cluster_col).asc()]


def rank_clusters(centroids: DataFrame, cluster_col: str, min_crashes: int = 0) -> DataFrame:
    """Clusters numbered from the highest rate down.

    ``min_crashes`` leaves out clusters too small for a meaningful rate; it needs
    the ``crashes`` column.
    """
    require_columns(centroids, cluster_col, "fatality_rate")
    if min_crashes:
        require_columns(centroids, "crashes")
        centroids = centroids.filter(F.col("crashes") >= min_crashes)
    return with_rank(centroids, *rate_order(cluster_col))


def nth_cluster(centroids: DataFrame, cluster_col: str, rank: int) -> DataFrame:
    """The ``rank``-th worst cluster (from 1), with its rate rounded for display; empty beyond the end."""
    if rank < 1:
        raise ValueError("rank counts from 1")
    require_columns(centroids, cluster_col, "fatality_rate")
    if rank <= TOP_N:
        order = Window.orderBy(*rate_order(cluster_col))
        top = centroids.orderBy(*rate_order(cluster_col)).limit(rank)
        ranked = top.withColumn("rank", F.row_number().over(order).cast("bigint"))
    else:
        ranked = rank_clusters(centroids, cluster_col)
    return (ranked.filter(F.col("rank") == rank)
            .withColumn("display_rate", F.bround("fatality_rate", 2)))
