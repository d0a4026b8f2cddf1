"""Fixed-radius neighbourhoods of weighted positions, by equality joins on grid cells.

A cell is the largest square with a power-of-two side whose diagonal does not
exceed the radius: all positions of one cell are neighbours without any test.
Tasks search whole squares of cells (``blocks``); the cells of squares too crowded
for a task meet as trees of boxes (``boxtree``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from blackspot.clustering.blocks import deal, weights
from blackspot.clustering.boxtree import handed_down, meetings, tree
from blackspot.runtime import cut

CELL_FACTOR = 1 << 30


def cell_bits(radius: int) -> int:
    """Largest b so that two positions in a square of side 2^b are within ``radius``."""
    b = 0
    while 2 * ((1 << (b + 1)) - 1) ** 2 <= radius * radius:
        b += 1
    return b


def cell_of(bits: int, x: str = "x", y: str = "y") -> Column:
    return F.shiftright(x, bits) * F.lit(CELL_FACTOR) + F.shiftright(y, bits)


def offsets(bits: int, radius: int) -> list[tuple[int, int]]:
    """Cell steps to all other cells that may hold a position within ``radius``."""
    side = 1 << bits
    gap = lambda d: max(abs(d) - 1, 0) * side + (1 if d else 0)
    reach = radius // side + 1
    return [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)
            if (i, j) != (0, 0) and gap(i) ** 2 + gap(j) ** 2 <= radius * radius]


def cells_in_reach(asked: DataFrame, held: DataFrame, bits: int, radius: int, ahead: bool = False) -> DataFrame:
    """Pairs ``(a_root, b_root)`` of different cells, one of ``asked`` and one of ``held``, that may hold near positions.

    Both have the column ``cell``. ``ahead`` gives every pair only once.
    """
    steps = [i * CELL_FACTOR + j for i, j in offsets(bits, radius) if not ahead or (i, j) > (0, 0)]
    return (asked.select(F.col("cell").alias("a_root"), F.explode(F.array(*[F.col("cell") + F.lit(d) for d in steps])).alias("b_root"))
            .join(held.select(F.col("cell").alias("b_root")), "b_root"))


def near_cells(asked: DataFrame, spots: DataFrame, bits: int, radius: int) -> DataFrame:
    """The rows of ``spots`` whose cell may hold a position near to one in a cell of ``asked``; both have ``cell``."""
    cells = asked.select("cell").distinct()
    around = cells_in_reach(cells, spots.select("cell").distinct(), bits, radius).select(F.col("b_root").alias("cell")).unionAll(cells).distinct()
    return spots.join(around, "cell", "left_semi")


def crowded_weights(asked: DataFrame, own: DataFrame, bits: int, radius: int) -> DataFrame:
    """``(x, y, weight)`` of the positions ``asked`` by trees of boxes; ``own`` are all that may be near, both with ``cell``."""
    rooted = lambda rows: tree(rows.select(F.col("cell").alias("root"), "x", "y", "w"), bits)
    answering, asking = rooted(own), rooted(asked)
    pairs = cells_in_reach(asked.select("cell").distinct(), own.select("cell").distinct(), bits, radius)
    inside, close = meetings(pairs, asking, answering, radius)
    given = inside.select(F.col("a_root").alias("root"), F.col("a_node").alias("node"), F.col("w").alias("value"))
    home = own.groupBy("cell").agg(F.sum("w").alias("weight"))
    return (asked.join(home, "cell").select("x", "y", "weight")
            .unionAll(handed_down(asking, given, "sum").select("x", "y", "value")).unionAll(close.select("x", "y", "w"))
            .groupBy("x", "y").agg(F.sum("weight").alias("weight")))


def neighbor_weights(spots: DataFrame, bits: int, radius: int) -> DataFrame:
    """``spots`` ``(x, y, w)`` with ``weight``: crashes within ``radius`` of every position, itself included."""
    dealt, crowded = deal(spots, bits, radius)
    near = weights(dealt, bits, radius)
    if crowded is None:
        return near
    crowded = cut(crowded.withColumn("cell", cell_of(bits)))
    own = cut(near_cells(crowded, spots.withColumn("cell", cell_of(bits)), bits, radius))
    found = crowded_weights(crowded, own, bits, radius)
    return near.unionByName(crowded.drop("cell").join(found, ["x", "y"]))
