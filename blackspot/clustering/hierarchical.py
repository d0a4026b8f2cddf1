"""Agglomerative clustering of crash positions, cut into about one cluster per 250 crashes.

The result is the flat cut of the full dendrogram, not an approximation, for all
crashes or for every group of crashes on its own. Nothing of size points x points
is built:

* All pairs of clusters that are each other's nearest are merged at once, round by
  round. For these linkages this gives the same tree as merging one pair at a
  time, and a merge never brings a cluster nearer to others; so a cluster searches
  again only if it or its nearest cluster was merged.
* Ward, complete and average linkage: tasks take whole squares of the map and make
  all merges that nothing outside the square can come before (``squares``).
* ``single`` of several large groups: the nearest cluster is found through grid cells
  around the positions.
* ``single`` over all crashes: the merges are the edges of the shortest spanning
  forest, which tasks find by whole squares of the map (``spanning``).

Groups go through the same rounds together; each has its own number of merges and
its own end. Group and cluster are only ever keys of joins, so a group may hold any
share of the crashes. Groups of at most ``SMALL`` positions need no rounds: a task
merges many of them at once (``groups``), by the same heights and the same order of ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from blackspot.clustering.components import components
from blackspot.clustering.grid import LEVELS, cells_around, cells_of, square
from blackspot.clustering.groups import NO_ID, cut_groups, numbered, whole_groups
from blackspot.clustering.kmeans import lay_out
from blackspot.clustering.points import label_rows, place
from blackspot.clustering.spanning import ROWS as ROWS_ALONG, STATE as FOREST_STATE, forest_round, forest_start, joined_by_rounds
from blackspot.clustering.squares import CLUSTERS, PER_TASK, ROWS, STATE, WIDEST, roots_by_square, round_of
from blackspot.functions.geo import morton
from blackspot.joins import split_join
from blackspot.operators.ranking import with_rank
from blackspot.operators.rates import CRASHES_PER_CLUSTER
from blackspot.runtime import cut, forget, require_columns, scratch_path

# The linkages on offer.
LINKAGES = ("ward", "complete", "average", "single")

# Factor by which a search that found nothing is widened.
WIDEN = 4
# Searches go this much beyond the last nearest cluster, since merges move it away.
SLACK = 2
# Positions of a cluster that one task measures against as many of another.
PART = 2048
# A group of at most so many positions fits into one task with all its distances (72 MB).
SMALL = 3000

# Bands of height by which merges are counted, for every doubling of the height.
BANDS = 256

MERGES = "grp string, lo bigint, hi bigint, height double"


def measure(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(lo, hi, value)`` for pairs of clusters ``(lo, hi, lo_places, hi_places)``: the least squared distance."""
    touched = pairs.select(F.col("lo").alias("id"), F.col("lo_places").alias("places")).unionAll(pairs.select("hi", "hi_places")).distinct()
    parts = lambda n: F.ceil(F.col(n) / F.lit(PART)).cast("bigint")
    rows = (split_join(members, touched, ["id"], "places", ["x", "y"])
            .select("id", "x", "y", "w", F.pmod(F.xxhash64("x", "y"), parts("places")).alias("part")))
    side = lambda key: rows.select(*[F.col(c).alias(f"{key}_{c}") for c in ("id", "part", "x", "y", "w")])
    spread = lambda key: F.explode(F.sequence(F.lit(0).cast("bigint"), parts(f"{key}_places") - 1))
    blocks = (pairs.select("*", spread("lo").alias("lo_part")).select("*", spread("hi").alias("hi_part"))
              .withColumnsRenamed({"lo": "lo_id", "hi": "hi_id"}))
    d2 = square(F.col("lo_x") - F.col("hi_x")) + square(F.col("lo_y") - F.col("hi_y"))
    return (blocks.join(side("lo"), ["lo_id", "lo_part"]).join(side("hi"), ["hi_id", "hi_part"])
            .groupBy(F.col("lo_id").alias("lo"), F.col("hi_id").alias("hi")).agg(F.min(d2).cast("double").alias("value")))


def widest() -> Column:
    return F.least("reach", F.lit(1 << (LEVELS - 1)).cast("bigint"))


def single_finds(queries: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, best)``: the shortest way from a position of each cluster to another cluster within reach."""
    asking = queries.select("id", "reach", "limit").join(members.select("grp", "id", "x", "y"), "id")
    around = cells_around(asking.withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y"), "reach": widest()}))
    cells = cells_of(members.select("grp", "id", "x", "y"), "x", "y", around)
    cell = ["grp", "level", "gx", "gy"]
    near = (around.select(*cell, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "limit")
            .join(cells.select(*cell, F.col("id").alias("b"), "x", "y"), cell).filter("a <> b"))
    height = F.sqrt((square(F.col("x") - F.col("ax")) + square(F.col("y") - F.col("ay"))).cast("double"))
    return (near.select(F.col("a").alias("id"), height.alias("height"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "limit")
            .filter("limit is null or height <= limit").groupBy("id").agg(F.min(F.struct("height", "lo", "hi")).alias("best")))


def nearest_clusters(queries: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster asked for: its nearest cluster found as ``(height, lo, hi)``, or NULL, and whether it is ``sure``.

    All positions within ``reach`` are looked at; the find is sure when nothing
    beyond the reach can be closer. Where the height of the cut is known to be at
    most ``limit``, nothing above it is measured, and a cluster without a find is
    done.
    """
    # Distance beyond which nothing can be linked at a height or less.
    beyond = lambda height: F.ceil(height * (1 + 1e-9)) + 3
    queries = queries.withColumn("reach", F.coalesce(beyond(F.col("limit")), F.col("reach")).cast("bigint"))
    needed = beyond(F.col("best.height"))
    return cut(queries.select("grp", "id", "n", "reach", "limit").join(single_finds(queries, members), "id", "left")
               .select("grp", "id", "best.height", "best.lo", "best.hi", F.coalesce(needed <= F.col("reach"), F.col("limit").isNotNull()).alias("sure"),
                       F.coalesce(needed, F.col("reach") * WIDEN).cast("bigint").alias("needed")))


def merged_clusters(clusters: DataFrame, nearest: DataFrame, merges: DataFrame) -> DataFrame:
    """Clusters after the merges; a merged cluster takes the lower id."""
    renamed = merges.select(F.col("hi").alias("id"), F.col("lo").alias("into"))
    wider = nearest.select("id", (F.greatest("needed", F.lit(1)) * SLACK).alias("wider"))
    state = clusters.join(wider, "id", "left").join(renamed, "id", "left").withColumn("id", F.coalesce("into", "id"))
    n = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / n
    grown = F.when(F.count(F.lit(1)) == 2,
                   F.min("n") / n * F.max("n") * (square(F.max("cx") - F.min("cx")) + square(F.max("cy") - F.min("cy")))).otherwise(F.lit(0.0))
    return state.groupBy("grp", "id").agg(
        n.alias("n"), F.sum("places").alias("places"), mean("cx").alias("cx"), mean("cy").alias("cy"), (F.sum("ss") + grown).alias("ss"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        F.max(F.coalesce("wider", "reach")).alias("reach"), F.max("limit").alias("limit"))


class Dendrogram:
    """Merges of at most ``SMALL`` clusters held by one task, one pair at a time.

    ``value`` holds the squared or summed distances of pairs as ``measure`` gives
    them; where one is not known, it is NaN and ``low`` of the pair bounds its height.
    """

    def __init__(self, rows: pd.DataFrame, linkage: str, value: np.ndarray | None):
        take = lambda *names: [rows[c].to_numpy(dtype=float) for c in names]
        self.linkage, self.value = linkage, value
        self.ids = rows["id"].to_numpy()
        self.n, self.cx, self.cy, self.ss, self.x0, self.x1, self.y0, self.y1 = take("n", "cx", "cy", "ss", "x0", "x1", "y0", "y1")
        self.alive = np.ones(len(rows), bool)

    def gap2(self, i: int) -> np.ndarray:
        return (self.cx[i] - self.cx) ** 2 + (self.cy[i] - self.cy) ** 2

    def low(self, i: int) -> np.ndarray:
        if self.linkage != "single":
            return np.sqrt(self.gap2(i)) * (1 - 1e-9) - 1e-2
        apart = lambda lo, hi: np.maximum(np.maximum(lo[i] - hi, lo - hi[i]), 0)
        return np.hypot(apart(self.x0, self.x1), apart(self.y0, self.y1))

    def heights(self, i: int) -> np.ndarray:
        """From cluster ``i`` to all others; dead ones, itself and unknown ones are out of reach."""
        if self.linkage == "ward":
            h = np.sqrt(2 * self.n[i] * self.n / (self.n[i] + self.n) * self.gap2(i))
        elif self.linkage == "guess":
            h = np.sqrt(self.gap2(i) + self.ss[i] / self.n[i] + self.ss / self.n)
        elif self.linkage == "average":
            h = np.round(self.value[i] / (self.n[i] * self.n), 3)
        else:
            h = np.sqrt(self.value[i])
        return np.where(self.alive & (np.arange(len(h)) != i) & ~np.isnan(h), h, np.inf)

    def unknown(self, i: int) -> float:
        """The least height that a pair of ``i`` without a value may have."""
        if self.value is None:
            return np.inf
        open_ = self.alive & np.isnan(self.value[i])
        open_[i] = False
        return float(self.low(i)[open_].min(initial=np.inf))

    def merges(self) -> Iterator[tuple[int, int, float]]:
        """All merges up to where an unknown pair could come first; ``stopped`` is that height."""
        count = len(self.ids)
        near, best = np.zeros(count, np.int64), np.zeros(count)
        for i in range(count):
            r = self.heights(i)
            near[i], best[i] = r.argmin(), r.min()
        open_ = np.array([self.unknown(i) for i in range(count)])
        for _ in range(count - 1):
            lo = int(best.argmin())
            hi, height = int(near[lo]), float(best[lo])
            self.stopped = float(np.where(self.alive, open_, np.inf).min())
            if not height < self.stopped:
                return
            yield int(self.ids[lo]), int(self.ids[hi]), height
            n, m = self.n[lo], self.n[hi]
            self.ss[lo] += self.ss[hi] + n * m / (n + m) * self.gap2(lo)[hi]
            self.cx[lo], self.cy[lo] = (n * self.cx[lo] + m * self.cx[hi]) / (n + m), (n * self.cy[lo] + m * self.cy[hi]) / (n + m)
            for low_, high_ in ((self.x0, self.x1), (self.y0, self.y1)):
                low_[lo], high_[lo] = min(low_[lo], low_[hi]), max(high_[lo], high_[hi])
            self.n[lo], self.alive[hi], best[hi] = n + m, False, np.inf
            if self.value is not None:
                join = {"average": np.add, "single": np.minimum}.get(self.linkage, np.maximum)
                self.value[lo] = self.value[:, lo] = join(self.value[lo], self.value[hi])
                open_ = np.minimum(open_, np.where(np.isnan(self.value[lo]), self.low(lo), np.inf))
                open_[lo] = self.unknown(lo)
            for i in {lo, *np.flatnonzero(self.alive & ((near == lo) | (near == hi))).tolist()}:
                r = self.heights(i)
                near[i], best[i] = r.argmin(), r.min()
            # Nothing comes nearer by a merge, but the pair with the merged cluster may now be the first of equals.
            first = self.alive & (self.heights(lo) == best) & (lo < near)
            near[first] = lo
        self.stopped = np.inf


def merge_rows(grp: str, merges: list[tuple], stopped: float) -> pd.DataFrame:
    """Merges of a group, and a row without clusters that says up to which height they are all."""
    return pd.DataFrame([(grp, *m) for m in merges] + [(grp, None, None, stopped)], columns=["grp", "lo", "hi", "height"]).astype({"lo": "Int64", "hi": "Int64"})


def merges_of_group(x: np.ndarray, y: np.ndarray, n: np.ndarray, linkage: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All merges ``lo, hi, height`` of one small group of positions, by their places in it."""
    d2 = ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2).astype(float)
    value = None if linkage == "ward" else n[:, None] * n * np.sqrt(d2) if linkage == "average" else d2
    rows = pd.DataFrame({"id": np.arange(len(x)), "n": n, "cx": x, "cy": y, "ss": 0.0, "x0": x, "x1": x, "y0": y, "y1": y})
    lo, hi, height = zip(*Dendrogram(rows, linkage, value).merges())
    return np.array(lo), np.array(hi), np.array(height)


def small_cuts(spots: DataFrame, linkage: str, per_cluster: int) -> DataFrame:
    """``(grp, x, y, cid)`` of groups of at most ``SMALL`` positions, whole groups in each task.

    A task cuts and numbers its groups, so neither merges nor ids leave it.
    """
    schema = "grp string, x bigint, y bigint, cid bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, "grp"):
            x, y, w = (table[c].to_numpy() for c in "xyw")
            wanted = np.maximum(np.add.reduceat(w, starts[:-1]) // per_cluster, 1)
            root = cut_groups(starts, x, y, w, np.diff(starts) - wanted, linkage, lambda *group: merges_of_group(*group, linkage))
            first_id = table["first_id"].fill_null(NO_ID).to_numpy()
            done = table.select(["grp", "x", "y"]).append_column("cid", pa.array(numbered(starts, root, first_id)))
            yield from done.combine_chunks().to_batches()

    rows = spots.select("grp", "x", "y", "z", "w", F.col("first_id").cast("bigint").alias("first_id"))
    return rows.repartition("grp").sortWithinPartitions("grp", "z").drop("z").mapInArrow(run, schema)


def reach_guess(rows: pd.DataFrame) -> pd.DataFrame:
    """About the height of the cut, from centres and spreads alone."""
    steps = max(len(rows) - int(rows["wanted"].iloc[0]), 1)
    tree = Dendrogram(rows.sort_values("id"), "guess", None)
    heights = [h for _, (_, _, h) in zip(range(steps), tree.merges())]
    return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "within": [2 * max(heights, default=1.0) + 1]})


def pairs_within(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of clusters that may be linked at the height ``within`` or below."""
    rows = rows.sort_values("id")
    tree, places, out = Dendrogram(rows, "single", None), rows["places"].to_numpy(), []
    for i in range(len(rows)):
        j = np.flatnonzero(tree.low(i) <= rows["within"].iloc[0])
        j = j[j > i]
        out.append(pd.DataFrame({"lo": tree.ids[i], "hi": tree.ids[j], "lo_places": places[i], "hi_places": places[j]}))
    return pd.concat(out).assign(grp=rows["grp"].iloc[0])[["grp", "lo", "hi", "lo_places", "hi_places"]]


def merges_of_clusters(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Merges of the clusters that a large group has left."""
    rows = rows.sort_values("id")
    value = np.full((len(rows), len(rows)), np.nan)
    lo, hi = (np.searchsorted(rows["id"].to_numpy(), pairs[c].to_numpy()) for c in ("lo", "hi"))
    value[lo, hi] = value[hi, lo] = pairs["value"].to_numpy()
    tree = Dendrogram(rows, "single", value)
    merges = list(tree.merges())
    return merge_rows(rows["grp"].iloc[0], merges, tree.stopped if len(rows) > 1 else np.inf)


def finish(clusters: DataFrame, members: DataFrame, done: DataFrame, quotas: DataFrame) -> DataFrame:
    """The remaining merges that matter in groups that have at most ``SMALL`` clusters left; ``quotas`` has those groups.

    Only pairs within a guessed height are measured; a group in which that was too
    low is done again with the double.
    """
    wanted = quotas.select("grp", (F.col("places") - F.col("needed")).alias("wanted"))
    todo = cut(clusters.join(wanted, "grp").groupBy("grp").applyInPandas(reach_guess, "grp string, within double"))
    known, out = done.sparkSession.createDataFrame([], "lo bigint, hi bigint, value double"), None
    while True:
        own = clusters.join(todo, "grp")
        pairs = cut(own.groupBy("grp").applyInPandas(pairs_within, "grp string, lo bigint, hi bigint, lo_places bigint, hi_places bigint"))
        known = cut(known.unionAll(measure(pairs.drop("grp").join(known, ["lo", "hi"], "left_anti"), members)))
        valued = pairs.select("grp", "lo", "hi").join(known, ["lo", "hi"])
        merges = cut(own.groupBy("grp").cogroup(valued.groupBy("grp")).applyInPandas(
            lambda rows, held: merges_of_clusters(rows, held) if len(rows) else pd.DataFrame(columns=["grp", "lo", "hi", "height"]), MERGES))
        stops = merges.filter("lo is null").select("grp", F.col("height").alias("stopped"))
        every = done.join(stops.select("grp"), "grp", "left_semi").unionAll(merges.filter("lo is not null"))
        cuts = stops.join(lowest(every, quotas.join(stops.select("grp"), "grp", "left_semi")), "grp", "left")
        whole = cut(cuts.filter("stopped = double('infinity') or limit < stopped").select("grp"))
        some = merges.filter("lo is not null").join(whole, "grp", "left_semi")
        out = some if out is None else out.unionAll(some)
        todo = cut(todo.join(whole, "grp", "left_anti").withColumn("within", 2 * F.col("within")))
        if todo.isEmpty():
            return out


def all_dendrograms(spots: DataFrame, quotas: DataFrame) -> DataFrame:
    """``(grp, lo, hi, height)``: the lower merges of every large group; ``spots`` has ``grp, id, x, y, z, w``."""
    large = split_join(spots, quotas.drop("needed"), ["grp"], "places", "id").drop("places")
    return cut(agglomerate(with_reach(large), quotas))


def agglomerate(spots: DataFrame, quotas: DataFrame) -> DataFrame:
    """``(grp, lo, hi, height)``: single-linkage merges of every group's dendrogram up to the height that its quota needs.

    ``spots`` has ``grp, id, x, y, w, reach`` with ids of their own in every group,
    ``quotas`` ``grp, places, needed``. Heights never fall along a tree, so the cut
    of a group is known once enough of its merges lie below everything still
    possible. A group that comes down to ``SMALL`` clusters leaves the rounds.
    """
    spark = spots.sparkSession
    at = lambda c, kind: F.col(c).cast(kind)
    clusters = cut(spots.select("grp", "id", F.col("w").alias("n"), F.lit(1).cast("bigint").alias("places"), at("x", "double").alias("cx"),
                                at("y", "double").alias("cy"), F.lit(0.0).alias("ss"), F.col("x").alias("x0"), F.col("x").alias("x1"),
                                F.col("y").alias("y0"), F.col("y").alias("y1"), "reach", F.lit(None).cast("double").alias("limit")))
    members = cut(spots.select("grp", "id", "x", "y", "w"))
    # One table that grows by the merges of a round; earlier ones are never written or summed again.
    path = scratch_path(spark, "merges")
    done, near, stuck = spark.createDataFrame([], MERGES), None, False
    least, made = quotas.agg(F.min("needed")).first()[0], 0
    none = quotas.select("grp", F.lit(None).cast("double").alias("limit"), F.lit(False).alias("over")).filter("over")
    while True:
        left = clusters.groupBy("grp").agg(F.count(F.lit(1)).alias("left")).filter(F.col("left") <= SMALL)
        few = cut(quotas.join(left.select("grp"), "grp"))
        if not few.isEmpty():
            own = lambda df: df if df is None else df.join(few.select("grp"), "grp", "left_semi")
            last = finish(own(clusters), own(members), done, few)
            last.write.mode("append").parquet(path)
            done = spark.read.schema(MERGES).parquet(path)
            rest = lambda df: df if df is None else cut(df.join(few.select("grp"), "grp", "left_anti"))
            clusters, members, near = rest(clusters), rest(members), rest(near)
            quotas = cut(quotas.join(few.select("grp"), "grp", "left_anti"))
            if quotas.isEmpty():
                return done
        queries = clusters if near is None else clusters.join(near.select("id"), "id", "left_anti")
        fresh = nearest_clusters(queries, members)
        near = cut(fresh if near is None else near.unionByName(fresh))
        merges = cut(near.filter("sure and lo is not null").groupBy("grp", "lo", "hi")
                     .agg(F.count(F.lit(1)).alias("both"), F.min("height").alias("height")).filter("both = 2").select("grp", "lo", "hi", "height"))
        ends = finished(near, done, quotas) if made >= least else none
        over = ends.filter("over").select("grp")
        if made >= least:
            merges = merges.join(over, "grp", "left_anti")
        more = merges.count()
        made += more
        if not more:
            if near.join(over, "grp", "left_anti").filter("not sure").isEmpty():
                # Nothing left to merge or to widen; ties may have left finds that are out of date.
                if stuck or near.filter("lo is not null").join(over, "grp", "left_anti").isEmpty():
                    return done
                near, stuck = None, True
                continue
        else:
            stuck = False
            merges.write.mode("append").parquet(path)
            done = spark.read.schema(MERGES).parquet(path)
        limits = ends.filter("limit is not null").select("grp", F.col("limit").alias("top"), "over")
        going = merged_clusters(clusters, near, merges).join(limits, "grp", "left").filter("over is null or not over")
        clusters = cut(going.withColumn("limit", F.coalesce("top", "limit")).drop("top", "over"), replaces=clusters)
        renamed = merges.select(F.col("hi").alias("id"), F.col("lo").alias("into"))
        members = cut(members.join(renamed, "id", "left").join(over, "grp", "left_anti")
                      .select("grp", F.coalesce("into", "id").alias("id"), "x", "y", "w"), replaces=members)
        gone = merges.select("lo").unionAll(merges.select("hi"))
        near = cut(near.filter("sure").join(gone.withColumnRenamed("lo", "_m"), F.col("lo") == F.col("_m"), "left_anti")
                   .join(gone.withColumnRenamed("lo", "_m"), F.col("hi") == F.col("_m"), "left_anti")
                   .join(over, "grp", "left_anti"), replaces=near)


def finished(near: DataFrame, done: DataFrame, quotas: DataFrame) -> DataFrame:
    """``(grp, limit, over)`` of the groups with enough merges: the lowest height known to have them all at or below it.

    A group is over once nothing that can still be merged lies at that height or
    below.
    """
    counts = done.groupBy("grp").agg(F.count(F.lit(1)).alias("merges"))
    ready = cut(counts.join(quotas, "grp").filter("merges >= needed"))
    if ready.isEmpty():
        return ready.select("grp", F.lit(None).cast("double").alias("limit"), F.lit(False).alias("over"))
    limits = lowest(done, ready)
    lower = F.when(F.col("sure"), F.col("height")).otherwise(F.lit(0.0))
    floors = near.groupBy("grp").agg(F.min(lower).alias("floor"))
    return cut(limits.join(floors, "grp", "left").select("grp", "limit", (F.col("floor").isNull() | (F.col("floor") > F.col("limit"))).alias("over")))


def band() -> Column:
    return F.floor(F.log2(F.col("height") + 1) * BANDS)


def by_band(banded: DataFrame) -> DataFrame:
    return banded.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("n"))


def sought_bands(counts: DataFrame, quotas: DataFrame) -> DataFrame:
    """``(grp, band, place)``: the band with the ``needed``-th lowest merge of every group that has so many, and its place there; ``counts`` has ``grp, band, n``."""
    # At most 64 * BANDS bands of a group.
    below = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = counts.withColumn("below", below).join(F.broadcast(quotas.select("grp", "needed")), "grp").filter("below < needed and needed <= below + n")
    return found.select("grp", "band", (F.col("needed") - F.col("below")).alias("place"))


def lowest(merges: DataFrame, quotas: DataFrame) -> DataFrame:
    """``(grp, limit)``: the height of the ``needed``-th lowest merge of every group of ``quotas``.

    Merges are counted by bands of about the same height, and only those of the band sought are sorted.
    """
    # A row per group that does not fit into a task: few, and a join by group would take all merges of one to one task.
    banded = merges.select("grp", "lo", "hi", "height", band().alias("band")).join(F.broadcast(quotas.select("grp")), "grp")
    sought = cut(sought_bands(by_band(banded), quotas))
    ranked = cut(with_rank(banded.join(F.broadcast(sought), ["grp", "band"]), "grp", "height", "lo", "hi"))
    first = ranked.groupBy("grp").agg((F.min("rank") + F.first("place") - 1).alias("rank"))
    return ranked.join(first, ["grp", "rank"]).select("grp", F.col("height").alias("limit"))


def merged_by_squares(spots: DataFrame, quotas: DataFrame, linkage: str) -> DataFrame:
    """``(node, root)`` of the cuts of every group by ward, complete or average linkage.

    ``spots`` has ``grp, id, x, y, w`` with ids of their own in every group, ``quotas``
    ``grp, places, needed``. Rounds of certain merges (``squares``) go on until nothing
    is left that may be merged at the height of its group's cut.
    """
    at = lambda c: F.col(c).cast("double").alias(c)
    state = cut(spots.select("grp", "id", at("x"), at("y"), "w", F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(True).alias("head"))
                .filter("x is not null and y is not null"))
    least, rounds, limits, counts = quotas.agg(F.min("needed")).first()[0], [], None, None
    size, parts, before = CLUSTERS, 0, None
    while True:
        rows, left, lightest = state.agg(F.count(F.lit(1)), F.count_if("head"), F.min("w")).first()
        if not rows:
            break
        if left == before and parts == 1 and size >= left:
            # Groups that lack positions have no more merges.
            break
        if before is not None and left > 0.8 * before and (size < WIDEST or left == before):
            # Little was certain: wider squares, in the end of all that is left.
            size *= 2
        before = left
        parts = max(min(rows // ROWS, left * CLUSTERS // (PER_TASK * size)), 1)
        found = cut(round_of(state, limits, linkage, len(rounds), parts, size, lightest))
        merges = found.filter("square is not null").select("grp", "square", F.col("id").alias("lo"), "hi", "height")
        state = found.filter("square is null").select(*[f.split()[0] for f in STATE.split(", ")])
        rounds.append(merges)
        # Bands are summed from round to round, so merges of earlier rounds are not read again.
        new = by_band(merges.select("grp", band().alias("band")))
        counts = cut(new if counts is None else counts.unionAll(new).groupBy("grp", "band").agg(F.sum("n").alias("n")), replaces=counts)
        if (counts.agg(F.sum("n")).first()[0] or 0) >= least:
            # No more than a band above the cut.
            edge = (F.pow(F.lit(2.0), (F.col("band") + 1) / F.lit(float(BANDS))) - 1) * (1 + 1e-9) + 1e-6
            limits = cut(sought_bands(counts, quotas).select("grp", edge.alias("limit")), replaces=limits)
    enough = counts.groupBy("grp").agg(F.sum("n").alias("merges")).join(quotas, "grp").filter("merges >= needed") if rounds else None
    limits = lowest(all_merges(rounds), enough.select("grp", "needed")) if rounds else None
    # A cluster is named once per round at most, and the maps of later rounds are small.
    roots = None
    limits = quotas.select("grp", F.lit(None).cast("double").alias("limit")) if limits is None else cut(limits)
    for merges in reversed(rounds):
        own = cut(roots_by_square(merges.join(F.broadcast(limits), "grp", "left").filter("limit is null or height <= limit")))
        if roots is not None:
            later = roots.select(F.col("id").alias("root"), F.col("root").alias("last"))
            roots = cut(own.join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
                        .unionAll(roots.join(own.select("id"), "id", "left_anti")))
        else:
            roots = own
    return roots.withColumnRenamed("id", "node")


def all_merges(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def cut_tree(merges: DataFrame, quotas: DataFrame) -> DataFrame:
    """Components left by the lowest merges of every group, equal heights included."""
    low = merges.join(lowest(merges, quotas), "grp").filter("height <= limit")
    return components(low.select(F.col("lo").alias("a"), F.col("hi").alias("b")))


def single_linkage(spots: DataFrame, needed: int) -> DataFrame:
    """``(node, root)`` of the single-linkage cut after ``needed`` merges, by ids of positions.

    ``spots`` has ``id, x, y, z``. The merges are the edges of the shortest forest; once a
    round has enough of them, certain or not, no longer ones are looked for.
    """
    quota = spots.sparkSession.createDataFrame([("", needed)], "grp string, needed bigint")
    top = lambda edges: lowest(edges.select(F.lit("").alias("grp"), F.col("a").alias("lo"), F.col("b").alias("hi"), "height"), quota).first()["limit"]
    state, rounds, limit, made, before, stretch = forest_start(spots), [], None, 0, None, ROWS_ALONG
    while True:
        rows = state.count()
        if not rows:
            break
        if before is not None and rows > before / 2:
            # Little was certain: longer stretches, in the end one of all that is left.
            stretch *= 2
        before = rows
        found = cut(forest_round(state, limit, max(rows // stretch, 1)))
        edges = found.filter("square is not null")
        rounds.append(edges.filter("sure"))
        sure, open_ = edges.agg(F.count_if("sure"), F.count_if(~F.col("sure"))).first()
        made += sure
        if limit is None and made + open_ >= needed:
            limit = top(all_merges([*rounds, edges.filter("not sure")]))
        state = found.filter("square is null").select(*FOREST_STATE)
    limit = top(all_merges(rounds))
    return joined_by_rounds([edges.filter(F.col("height") <= limit) for edges in rounds]).withColumnRenamed("id", "node")


def hierarchical_positions(spots: DataFrame, linkage: str, per_cluster: int) -> DataFrame:
    """``(grp, x, y, cid)`` with the clusters of a group numbered from 1 by their first crash.

    ``spots`` has ``grp, x, y, z, w, first_id``.
    """
    groups = spots.groupBy("grp").agg(F.sum("w").alias("crashes"), F.count(F.lit(1)).alias("places"))
    large = cut(groups.filter(F.col("places") > SMALL))
    if large.isEmpty():
        return small_cuts(spots, linkage, per_cluster)
    # One key per SMALL positions at most.
    keys = F.broadcast(large.select("grp"))
    few = small_cuts(spots.join(keys, "grp", "left_anti"), linkage, per_cluster)
    return few.unionByName(large_cuts(spots.join(keys, "grp"), large, linkage, per_cluster))


def large_cuts(spots: DataFrame, groups: DataFrame, linkage: str, per_cluster: int) -> DataFrame:
    """``(grp, x, y, cid)`` of ``groups`` ``(grp, crashes, places)`` that do not fit into a task."""
    named = with_rank(spots, "grp", "z", name="id")
    wanted = F.greatest(F.expr(f"crashes div {per_cluster}"), F.lit(1))
    quotas = cut(groups.select("grp", "places", (F.col("places") - wanted).alias("needed")).filter("needed > 0"))
    if quotas.isEmpty():
        roots = None
    else:
        if linkage == "single" and groups.count() == 1:
            roots = single_linkage(named, quotas.first()["needed"])
        elif linkage == "single":
            roots = cut_tree(all_dendrograms(named, quotas), quotas)
        else:
            large = split_join(named, quotas.drop("needed"), ["grp"], "places", "id").drop("places")
            roots = merged_by_squares(large, quotas, linkage)
        roots = roots.withColumnRenamed("node", "id")
    rooted = named.withColumn("root", F.col("id")) if roots is None else named.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = cut(rooted.select("grp", "x", "y", "root", "first_id"))
    order = with_rank(rooted.groupBy("grp", "root").agg(F.min("first_id").alias("first_id")), "grp", "first_id", name="cid")
    first = order.groupBy("grp").agg(F.min("cid").alias("first"))
    numbered = order.join(first, "grp").select("root", (F.col("cid") - F.col("first") + 1).alias("cid"))
    return rooted.join(numbered, "root").select("grp", "x", "y", "cid")


def with_reach(named: DataFrame) -> DataFrame:
    """First search width of every position: the distance to its neighbours along the curve."""
    curve = Window.partitionBy("run").orderBy("z")
    places = named.groupBy("x", "y", "z").agg(F.sum("w").alias("w"))
    laid = lay_out(places).withColumnRenamed("leaf", "run")
    step = lambda f: square(F.col("x") - f("x").over(curve)) + square(F.col("y") - f("y").over(curve))
    nearest = F.coalesce(F.least(step(F.lag), step(F.lead)), F.lit(1 << 20).cast("bigint"))
    reach = laid.select("x", "y", (F.ceil(F.sqrt(nearest.cast("double"))).cast("bigint") + 3).alias("reach"))
    return cut(named.join(reach, ["x", "y"]).select("grp", "id", "x", "y", "w", "reach"))


def hierarchical(df: DataFrame, linkage: str = "ward", per_cluster: int = CRASHES_PER_CLUSTER,
                 label: str = "hier_cluster", by: str | None = None) -> DataFrame:
    """Crash rows with a position, each with its cluster (from 1).

    With ``by`` the crashes of every value of that column are clustered on their
    own, all in the same rounds, and numbered on their own; rows without a value
    are a group too.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {', '.join(LINKAGES)}")
    if by is not None:
        require_columns(df, by)
    # Every value, and none, as a text of its own.
    group = F.lit("") if by is None else F.to_json(F.struct(F.col(by).alias("by")))
    placed = place(df).withColumn("grp", group)
    spots = cut(placed.groupBy("grp", "x", "y").agg(F.count(F.lit(1)).alias("w"), F.min("Crash_ID").alias("first_id"))
                .withColumn("z", morton(F.col("x"), F.col("y"))))
    labels = cut(hierarchical_positions(spots, linkage, per_cluster))
    return label_rows(placed, labels.withColumnRenamed("cid", label), label, keys=["grp", "x", "y"])
