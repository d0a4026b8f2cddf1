"""Search for nearby points by equality joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Grid levels: cells of side 2^level micro-degrees; the last one spans the globe.
LEVELS = 30


def square(c: Column) -> Column:
    return c * c


def near2(x: Column, y: Column, box: str = "") -> Column:
    """Squared distance from a point to the closest spot of the box ``x0..x1, y0..y1``."""
    x0, x1, y0, y1 = (F.col(f"{box}{c}") for c in ("x0", "x1", "y0", "y1"))
    zero = F.lit(0).cast("bigint")
    return square(F.greatest(x0 - x, x - x1, zero)) + square(F.greatest(y0 - y, y - y1, zero))


def far2(x: Column, y: Column, box: str = "") -> Column:
    """Squared distance from a point to the farthest spot of the box ``x0..x1, y0..y1``."""
    x0, x1, y0, y1 = (F.col(f"{box}{c}") for c in ("x0", "x1", "y0", "y1"))
    return square(F.greatest(x - x0, x1 - x)) + square(F.greatest(y - y0, y1 - y))


def reach_of(squared: Column) -> Column:
    """A whole number not below the square root."""
    return F.ceil(F.sqrt(squared.cast("double"))) + 1


def search_level(span: Column) -> Column:
    """Level on which a stretch of length ``span`` touches three or four cells."""
    level = F.ceil(F.log2(F.greatest(span / F.lit(3.0), F.lit(1.0))))
    return F.least(level, F.lit(LEVELS - 1)).cast("int")


def cells_around(queries: DataFrame) -> DataFrame:
    """One row per grid cell touched by the box of a query widened by its ``reach``.

    The level follows the size of the widened box, so that a query never touches
    more than sixteen cells, in dense and in empty areas alike.
    """
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * F.col("reach")
    cells = lambda lo, hi: F.explode(F.expr(f"sequence(shiftright({lo}, level), shiftright({hi}, level))"))
    return (queries.withColumn("level", search_level(span))
            .withColumn("gx", cells("x0 - reach", "x1 + reach"))
            .withColumn("gy", cells("y0 - reach", "y1 + reach")))


def cells_of(targets: DataFrame, x: str, y: str, around: DataFrame) -> DataFrame:
    """One row per level asked for in ``around``, with the cell that holds the point."""
    asked = around.agg(F.collect_set("level").alias("levels")).scalar()
    return (targets.withColumn("level", F.explode(asked))
            .withColumns({"gx": F.expr(f"shiftright({x}, level)"), "gy": F.expr(f"shiftright({y}, level)")}))
