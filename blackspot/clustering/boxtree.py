"""Trees of boxes over groups of positions, and meetings of two such trees within a radius.

A group (a grid cell, or the part of one that belongs to a cluster) is the root.
A box with more than ``LEAF`` positions is opened into 4 x 4 boxes on a finer
grid, others keep their positions as a short list. Two groups meet box against
box: a pair of boxes wholly inside the radius is settled as a whole, one wholly
outside is dropped, only pairs across it are opened further, and at the end short
lists are compared. The scheme is the same in thin and in crowded places, and a
pair of crowded groups costs as much as the boundary between near and far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from blackspot.clustering.grid import square
from blackspot.runtime import cut, forget

#: Positions a box may have without being opened.
LEAF = 64
#: Bits per step: a box is opened into 2^2 x 2^2 boxes.
STEP_BITS = 2
ROOT = -1
LEVEL_BITS = 4

BOX = ["x0", "x1", "y0", "y1"]


def box_key(bits: int) -> Column:
    """Number of the grid square of side ``2^bits`` that holds a position; different for every level."""
    return F.shiftleft(F.shiftleft(F.shiftright("x", bits), 30).bitwiseOR(F.shiftright("y", bits)), LEVEL_BITS).bitwiseOR(F.lit(bits))


def summary() -> list[Column]:
    return [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")]


def tree(members: DataFrame, bits: int) -> DataFrame:
    """Boxes ``(root, node, parent, x0, x1, y0, y1, w, n, pts)`` of ``members`` ``(root, x, y, w)``.

    A position occurs once in a group, and a group lies within one square of side
    ``2^bits``. ``pts`` is the list of positions of a box that is not opened.
    """
    rows = members.select("root", "x", "y", "w", F.lit(ROOT).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("parent"))
    levels = []
    for level in [*range(bits - STEP_BITS, 0, -STEP_BITS), 0, None]:
        boxes = rows.groupBy("root", "node").agg(F.first("parent").alias("parent"), *summary())
        crowded = boxes.filter(F.col("n") > LEAF).select("root", "node")
        short = rows.join(crowded, ["root", "node"], "left_anti").groupBy("root", "node").agg(F.collect_list(F.struct("x", "y", "w")).alias("pts"))
        levels.append(cut(boxes.join(short, ["root", "node"], "left")))
        crowded = levels[-1].filter(F.col("n") > LEAF).select("root", "node")
        if level is None or crowded.isEmpty():
            break
        rows = rows.join(crowded, ["root", "node"]).select("root", "x", "y", "w", box_key(level).alias("node"), F.col("node").alias("parent"))
    out = levels[0]
    for boxes in levels[1:]:
        out = out.unionAll(boxes)
    return out


def gap(a: str, b: str) -> Column:
    """Squared distance between the closest places of two boxes."""
    apart = lambda c: F.greatest(F.col(f"{a}{c}0") - F.col(f"{b}{c}1"), F.col(f"{b}{c}0") - F.col(f"{a}{c}1"), F.lit(0).cast("bigint"))
    return square(apart("x")) + square(apart("y"))


def span(a: str, b: str) -> Column:
    """Squared distance between the farthest places of two boxes."""
    wide = lambda c: F.greatest(F.col(f"{a}{c}1") - F.col(f"{b}{c}0"), F.col(f"{b}{c}1") - F.col(f"{a}{c}0"))
    return square(wide("x")) + square(wide("y"))


def side(boxes: DataFrame, p: str, *keep: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{p}_{c}") for c in ("root", "node", *BOX, "w", "n", "pts", *keep)])


def opened(state: DataFrame, kids: DataFrame, p: str) -> DataFrame:
    """``state`` with the boxes of side ``p`` replaced by their children; short boxes stay.

    ``kids`` are all boxes but the roots, by parent.
    """
    columns = state.columns
    done = state.filter(f"{p}_pts is not null")
    more = (state.filter(f"{p}_pts is null").withColumnRenamed(f"{p}_node", "_parent")
            .drop(*[f"{p}_{c}" for c in (*BOX, "w", "n", "pts")]).join(kids, [f"{p}_root", "_parent"]))
    return done.unionByName(more.select(*columns))


def meetings(pairs: DataFrame, asking: DataFrame, answering: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Meetings of the groups ``(a_root, b_root)`` of ``pairs`` within ``radius``.

    The first result has pairs of boxes that are wholly inside: ``a_root, a_node,
    b_root, w`` with the weight ``w`` of the answering box. The second has single
    positions of the asking side: ``a_root, x, y, b_root, w`` with the weight of
    the answering positions near them.
    """
    limit = F.lit(radius * radius)
    kids = {p: side(boxes.filter(F.col("node") != ROOT), p, "parent").withColumnRenamed(f"{p}_parent", "_parent")
            for p, boxes in (("a", asking), ("b", answering))}
    roots = {p: side(boxes.filter(F.col("node") == ROOT), p) for p, boxes in (("a", asking), ("b", answering))}
    state = pairs.select("a_root", "b_root").join(roots["a"], "a_root").join(roots["b"], "b_root").filter(gap("a_", "b_") <= limit)
    columns = ["a_root", "a_node", "b_root", "b_w"]
    inside, across, last = None, None, None
    while True:
        state = cut(state.withColumn("inside", span("a_", "b_") <= limit))
        if last is not None:
            forget(last)
        whole = cut(state.filter("inside").select(*columns))
        inside = whole if inside is None else inside.unionAll(whole)
        open_ = state.filter("not inside")
        lists = cut(open_.filter("a_pts is not null and b_pts is not null").select("a_root", "a_pts", "b_root", "b_pts"))
        across = lists if across is None else across.unionAll(lists)
        open_ = open_.filter("a_pts is null or b_pts is null").drop("inside")
        if open_.isEmpty():
            forget(state)
            break
        last = state
        state = opened(opened(open_, kids["a"], "a"), kids["b"], "b").filter(gap("a_", "b_") <= limit)
    close = (across.select("a_root", "b_root", "b_pts", F.explode("a_pts").alias("p")).select("a_root", "b_root", "p.x", "p.y", F.explode("b_pts").alias("q"))
             .filter(square(F.col("x") - F.col("q.x")) + square(F.col("y") - F.col("q.y")) <= limit)
             .groupBy("a_root", "x", "y", "b_root").agg(F.sum("q.w").alias("w")))
    return inside.withColumnRenamed("b_w", "w"), close


def handed_down(boxes: DataFrame, given: DataFrame, merge: str) -> DataFrame:
    """``(root, x, y, value)``: what the boxes above every position were given, merged by ``sum`` or ``min``.

    ``given`` is ``(root, node, value)``. Boxes pass what they have to the boxes
    within them, level by level, and short boxes to their positions.
    """
    pick = {"sum": F.sum, "min": F.min}[merge]
    both = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if merge == "sum" else F.least
    own = given.groupBy("root", "node").agg(pick("value").alias("value"))
    boxes = cut(boxes.select("root", "node", "parent", "pts").join(own, ["root", "node"], "left"))
    level, out = boxes.filter(F.col("node") == ROOT), None
    while True:
        spots = level.filter("pts is not null and value is not null").select("root", F.inline("pts"), "value").drop("w")
        out = spots if out is None else out.unionAll(spots)
        above = level.filter("pts is null").select("root", F.col("node").alias("parent"), F.col("value").alias("above"))
        below = boxes.join(above, ["root", "parent"]).withColumn("value", both(F.col("value"), F.col("above"))).drop("above")
        level = cut(below)
        if level.isEmpty():
            return out


def closest(pairs: DataFrame, members: DataFrame, bits: int, radius: int, exact: bool) -> DataFrame:
    """Pairs of groups ``(a, b)`` that come within ``radius``; with ``exact`` also the squared distance ``d2`` of their closest members.

    ``members`` is ``(grp, x, y)``; a group lies within one square of side
    ``2^bits``. Without ``exact`` a pair is accepted as soon as two of its boxes are
    surely within reach.
    """
    limit = F.lit(radius * radius)
    boxes = tree(members.select(F.col("grp").alias("root"), "x", "y", F.lit(1).cast("bigint").alias("w")), bits)
    kids = {p: side(boxes.filter(F.col("node") != ROOT), p, "parent").withColumnRenamed(f"{p}_parent", "_parent") for p in "ab"}
    roots = {p: side(boxes.filter(F.col("node") == ROOT), p) for p in "ab"}
    state = (pairs.select(F.col("a").alias("a_root"), F.col("b").alias("b_root")).join(roots["a"], "a_root").join(roots["b"], "b_root")
             .filter(gap("a_", "b_") <= limit))
    found, last = None, None
    while True:
        state = cut(state.withColumns({"near": gap("a_", "b_"), "far": span("a_", "b_")}))
        if last is not None:
            forget(last)
        bound = state.groupBy("a_root", "b_root").agg(F.min("far").alias("bound"))
        if not exact:
            sure = cut(bound.filter(F.col("bound") <= limit).select("a_root", "b_root"))
            found = sure if found is None else found.unionAll(sure)
            bound = bound.filter(F.col("bound") > limit)
        open_ = (state.join(bound.withColumn("bound", F.least("bound", limit)), ["a_root", "b_root"])
                 .filter(F.col("near") <= F.col("bound")).drop("near", "far"))
        # Lists that met already are measured now, so that they bound the others of their pair.
        lists = open_.filter("a_pts is not null and b_pts is not null").select("a_root", "b_root", "b_pts", F.explode("a_pts").alias("p"))
        lists = (lists.select("a_root", "b_root", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.explode("b_pts").alias("q"))
                 .select("a_root", "b_root", (square(F.col("x") - F.col("q.x")) + square(F.col("y") - F.col("q.y"))).alias("d2")).filter(F.col("d2") <= limit))
        lists = cut(lists.groupBy("a_root", "b_root").agg(F.min("d2").alias("d2")))
        found = (lists if exact else lists.drop("d2")) if found is None else found.unionAll(lists if exact else lists.drop("d2"))
        more = open_.filter("a_pts is null or b_pts is null").join(lists.withColumnRenamed("d2", "_best"), ["a_root", "b_root"], "left")
        more = more.filter(F.col("_best").isNull() | (gap("a_", "b_") < F.col("_best"))) if exact else more.filter("_best is null")
        more = more.drop("_best", "bound")
        if more.isEmpty():
            forget(state)
            break
        last = state
        state = opened(opened(more, kids["a"], "a"), kids["b"], "b").filter(gap("a_", "b_") <= limit)
    found = found.withColumnsRenamed({"a_root": "a", "b_root": "b"})
    return found.groupBy("a", "b").agg(F.min("d2").alias("d2")) if exact else found.distinct()
