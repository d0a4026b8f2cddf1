"""Density-based clustering of crash positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blackspot.clustering.blocks import deal, links
from blackspot.clustering.boxtree import closest, handed_down, meetings, tree
from blackspot.clustering.components import components
from blackspot.clustering.neighbors import cell_bits, cell_of, cells_in_reach, near_cells, neighbor_weights
from blackspot.clustering.points import label_rows, place, positions
from blackspot.functions.geo import MICRO
from blackspot.operators.ranking import with_rank
from blackspot.runtime import cut

# Defaults of the operator.
EPS_DEGREES = 0.003
MIN_SAMPLES = 100
NOISE = -1


def neighbor_counts(df: DataFrame, eps: float = EPS_DEGREES) -> DataFrame:
    """Every crash with the number of crashes within ``eps`` degrees, itself included."""
    radius = round(eps * MICRO)
    placed = place(df)
    spots = cut(positions(placed).drop("z"))
    counts = neighbor_weights(spots, cell_bits(radius), radius)
    return label_rows(placed, counts.withColumnRenamed("weight", "neighbors"), "neighbors")


def linked(spots: DataFrame, bits: int, radius: int) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None]:
    """``(a, b)``, pairs that connect the cells with core positions within ``radius`` of each other, and ``(x, y, cell)``, cells that other positions reach.

    ``spots`` has ``x, y, w, cell, core``. Of cells that belong together a position
    reaches one. Positions in crowded squares that are not core are returned with the
    core positions around them instead.
    """
    dealt, crowded = deal(spots, bits, radius)
    found = cut(links(dealt, bits, radius))
    pairs = found.filter("x is null").select(F.col("cell").alias("a"), F.col("root").alias("b"))
    reached = found.filter("x is not null").select("x", "y", "cell")
    if crowded is None:
        return pairs, reached, None
    crowded = cut(crowded)
    own = cut(near_cells(crowded, spots.filter("core"), bits, radius))
    asking = cells_in_reach(crowded.filter("core").select("cell").distinct(), own.select("cell").distinct(), bits, radius)
    asking = asking.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct()
    pairs = pairs.unionAll(closest(asking, own.select(F.col("cell").alias("grp"), "x", "y"), bits, radius, exact=False))
    return pairs, reached, (cut(crowded.filter("not core")), own)


def crowded_border(edge: DataFrame, core: DataFrame, cell_labels: DataFrame, bits: int, radius: int) -> DataFrame:
    """``(x, y, cid)``: clusters that positions of crowded squares reach, by trees of boxes."""
    at_home = edge.join(cell_labels, "cell").select("x", "y", "cid")
    rooted = lambda rows: tree(rows.select(F.col("cell").alias("root"), "x", "y", "w"), bits)
    asking = rooted(edge)
    inside, close = meetings(cells_in_reach(edge.select("cell").distinct(), core.select("cell").distinct(), bits, radius), asking, rooted(core), radius)
    of_cell = cell_labels.withColumnRenamed("cell", "b_root")
    given = inside.join(of_cell, "b_root").select(F.col("a_root").alias("root"), F.col("a_node").alias("node"), F.col("cid").alias("value"))
    return (at_home.unionAll(handed_down(asking, given, "min").select("x", "y", F.col("value").alias("cid")))
            .unionAll(close.join(of_cell, "b_root").select("x", "y", "cid")))


def linked_cells(core: DataFrame, bits: int, radius: int) -> DataFrame:
    """Pairs of cells that connect those with positions of ``core`` ``(x, y, w, cell)`` within ``radius`` of each other."""
    return linked(core.withColumn("core", F.lit(True)), bits, radius)[0]


def dbscan_positions(spots: DataFrame, radius: int, min_samples: int) -> DataFrame:
    """``(x, y, cid)`` of all positions in a cluster; ``spots`` has ``x, y, w, first_id``.

    A position is core when at least ``min_samples`` crashes lie within the radius.
    Clusters are joined between cells, numbered by their first core crash, and a
    border position takes the lowest cluster in reach.
    """
    bits = cell_bits(radius)
    spots = cut(spots.select("x", "y", "w", "first_id"))
    counted = neighbor_weights(spots, bits, radius).withColumns({"core": F.col("weight") >= min_samples, "cell": cell_of(bits)}).drop("weight")
    spots = cut(counted, replaces=spots)
    pairs, reached, crowded = linked(spots, bits, radius)
    core = spots.filter("core")

    cells = core.groupBy("cell").agg(F.min("first_id").alias("first_id"))
    rooted = cut(cells.join(components(pairs).withColumnRenamed("node", "cell"), "cell", "left")
                 .withColumn("root", F.coalesce("root", "cell")))
    order = rooted.groupBy("root").agg(F.min("first_id").alias("first_id"))
    numbered = with_rank(order, "first_id", name="cid").select("root", (F.col("cid") - 1).alias("cid"))
    cell_labels = cut(rooted.join(numbered, "root").select("cell", "cid"))
    reached = reached.join(cell_labels, "cell").select("x", "y", "cid")
    if crowded is not None:
        reached = reached.unionAll(crowded_border(*crowded, cell_labels, bits, radius))
    border = reached.groupBy("x", "y").agg(F.min("cid").alias("cid"))
    return core.join(cell_labels, "cell").select("x", "y", "cid").unionAll(border)


def dbscan(df: DataFrame, eps: float = EPS_DEGREES, min_samples: int = MIN_SAMPLES,
           label: str = "DBSCAN_cluster") -> DataFrame:
    """Crash rows with a position, each with its cluster (from 0) or -1 for noise."""
    placed = place(df)
    spots = positions(placed, F.min("Crash_ID").alias("first_id"))
    labels = dbscan_positions(spots, round(eps * MICRO), min_samples)
    return label_rows(placed, labels.withColumnRenamed("cid", label), label, default=NOISE)


def dbscan_summary(labeled: DataFrame, label: str = "DBSCAN_cluster") -> DataFrame:
    """Crashes and deaths per cluster, noise included."""
    return labeled.groupBy(label).agg(F.count(F.lit(1)).alias("crashes"), F.sum("Death_Cnt").alias("deaths"))
