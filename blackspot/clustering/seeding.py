"""A start of k-means by oversampling: seeds that follow the distances, not the crowd alone.

From one position on, every round draws each position with a probability that
grows with its weight and squared distance to the nearest candidate so far, about
``OVERSAMPLE`` candidates per cluster and round. The draw compares a hash of the
position with that probability, so it can be repeated and needs no random state.
Candidates then weigh as much as the crashes nearest to them, and are reduced to
one per cluster on their own: those heavier than a share become seeds outright,
the others share the rest along the curve, and a few rounds of k-means over the
weighted candidates move the seeds. All of it is on tables, candidates included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from blackspot.clustering.kmeans import assign, lay_out, rounds
from blackspot.clustering.tiles import spots_of, tiles_of, weight_of
from blackspot.functions.geo import morton
from blackspot.operators.ranking import ROW_BITS, part_offsets, sorted_rows
from blackspot.runtime import cut, forget

# Parameters of the start: candidates per cluster and round, rounds of drawing, rounds of k-means over the candidates.
OVERSAMPLE = 2
DRAWS = 5
REDUCE_ROUNDS = 5

# Fixed values of the hash, shared with its SQL: a prime, and multipliers.
PRIME = 2147483647
HASH_SQL = [f"(x * 1000003 + y * 998244353 + {{turn}} * 12582917) % {PRIME}",
            f"(h * (h % 65521 + 48271)) % {PRIME}", f"(h * (h % 32749 + 16807)) % {PRIME}"]


def hash_of(turn: int) -> Column:
    """A number below ``PRIME`` for the position ``(x, y)`` in a round, from whole-number arithmetic alone."""
    text = HASH_SQL[0].format(turn=turn)
    for step in HASH_SQL[1:]:
        text = step.replace("h", f"({text})")
    return F.expr(text)


def numbered(tiles: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen positions ``(tile, x, y, z)`` as centres numbered along the curve, and the tiles with the centres in and beside each."""
    counted = tiles.select("tile").join(chosen.groupBy("tile").agg(F.count(F.lit(1)).alias("n")), "tile", "left").fillna(0, ["n"])
    rows = sorted_rows(counted, "tile").withColumn("_part", F.shiftright("_row", ROW_BITS))
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(rows.join(F.broadcast(part_offsets(rows, F.col("n"))), "_part")
                 .select("tile", "n", (F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before")))
    centers = (chosen.join(before, "tile")
               .select((F.col("before") + F.row_number().over(Window.partitionBy("tile").orderBy("z")) - 1).alias("cid"),
                       F.col("x").alias("cx"), F.col("y").alias("cy")))
    hints = before.select("tile", F.sequence(F.col("before") - 1, F.col("before") + F.col("n")).alias("hints"))
    return cut(centers), tiles.drop("hints", "cums").join(hints, "tile")


def placed(tiles: DataFrame) -> DataFrame:
    """``(tile, x, y, z)``: the positions of the tiles with their place on the curve."""
    return spots_of(tiles).select("tile", "x", "y", morton(F.col("x"), F.col("y")).alias("z"))


def candidates(tiles: DataFrame, clusters: int) -> DataFrame:
    """``(x, y, w, z)``: drawn positions with the weight of the positions nearest to them."""
    place = ["tile", "x", "y", "z"]
    chosen = cut(placed(tiles).orderBy(hash_of(0), "z").limit(1))
    for turn in range(1, DRAWS + 1):
        centers, hinted = numbered(tiles, chosen)
        apart = cut(assign(hinted, centers).select("tile", "x", "y", "w", "d2"))
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        cost = apart.agg(F.sum(wide("w") * wide("d2")).cast("double")).scalar()
        share = F.col("w").cast("double") * F.col("d2").cast("double") * F.lit(float(OVERSAMPLE * clusters * PRIME))
        drawn = apart.filter(hash_of(turn).cast("double") * cost < share).withColumn("z", morton(F.col("x"), F.col("y"))).select(*place)
        chosen = cut(chosen.unionAll(drawn))
        forget(apart)
    centers, hinted = numbered(tiles, chosen)
    return (assign(hinted, centers).groupBy("cid").agg(F.first("cx").alias("x"), F.first("cy").alias("y"), F.sum("w").alias("w"))
            .select("x", "y", "w", morton(F.col("x"), F.col("y")).alias("z")))


def reduced(weighted: DataFrame, clusters: int) -> DataFrame:
    """Exactly ``clusters`` of the weighted candidates, or all of them if there are no more: ``(z, x, y)``.

    A candidate with at least an equal share of what heavier ones leave is taken
    outright; the others are passed along the curve, and each that completes a share is taken.
    """
    total, count = weighted.agg(F.sum("w"), F.count(F.lit(1))).first()
    if count <= clusters:
        return weighted.select("z", "x", "y")
    taken, left, rest = 0, clusters, total
    while True:
        heavy = F.expr(f"cast(w as decimal(19,0)) * {left} >= {rest}")
        more, weight = weighted.filter(heavy).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if more == taken:
            break
        taken, left, rest = more, clusters - more, total - weight
    passed = lambda c: F.expr(f"(cast({c} as decimal(19,0)) * {left}) div cast({rest} as decimal(19,0))")
    light = lay_out(weighted.filter(~heavy))
    return (weighted.filter(heavy).select("z", "x", "y")
            .unionAll(light.filter(passed("cum") > passed("(cum - w)")).select("z", "x", "y")))


def parallel_start(laid: DataFrame, per_cluster: int) -> tuple[DataFrame, DataFrame]:
    """Centres ``(cid, cx, cy)`` from oversampled candidates, and tiles with the centres beside each; a start for ``lloyd``."""
    tiles = cut(tiles_of(laid))
    clusters = max(weight_of(tiles) // per_cluster, 1)
    weighted = cut(candidates(tiles, clusters))
    picked = cut(reduced(weighted, clusters))
    own = cut(tiles_of(lay_out(weighted)))
    among = lambda tiles: placed(tiles).join(picked.select("z"), "z").select("tile", "x", "y", "z")
    centers, own_tiles = numbered(own, among(own))
    _, hinted = numbered(tiles, among(tiles))
    return rounds(cut(own_tiles), centers, REDUCE_ROUNDS, 0)[0].select("cid", "cx", "cy"), cut(hinted, replaces=tiles)
