"""Rounds of hierarchical clustering by tasks that take whole squares of the map.

Clusters lie along a Z-order curve by their centroids, and a task takes a stretch of
it. It cuts the stretch into squares of at most ``CLUSTERS`` clusters and merges, in
arrays, every pair of clusters that are each other's nearest and nearer than anything
outside the square can be: linkage is never smaller than the distance between centroids
(ward by a known factor), so the way to the border bounds it. Such merges belong to the
tree whatever lies outside. The squares of the next round lie elsewhere and are wider,
since fewer clusters are left. Once the height of the cut is bounded, a cluster that has
nothing within that height leaves the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blackspot.clustering.groups import whole_groups
from blackspot.functions.geo import morton

#: Clusters of a square at first, and once rounds settle little.
CLUSTERS, WIDEST = 512, 2048
#: Rows, or clusters where these have many rows, that one task takes along the curve.
ROWS, PER_TASK = 1 << 14, 1 << 11
#: Positions of a square of which all distances are measured at once; above, only those of contenders.
MEASURED = 1 << 10
#: Distances measured at once between two clusters, and between several pairs of small ones.
PAIRS, TOGETHER = 1 << 20, 1 << 15
#: Positions of a cluster above which inner ones are put together for complete linkage.
OUTLINED = 8
#: Share of the clusters left that a pass over the squares of a stretch must have merged for another pass.
SETTLED = 0.1
#: Clusters at first for each one left after which there is no other pass: what is above the cut is dear to measure.
GROWN = 8
#: Bits of a side of the whole map, and of what it is moved by from round to round.
MAP_BITS, MOVE_BITS = 31, 29
#: The moves: multiples of two odd numbers, so that no border stays a border.
MOVES = 0x13C6EF37, 0x0F1BBCDD

STATE = "grp string, id bigint, x double, y double, w bigint, cx bigint, cy bigint, head boolean"
FOUND = f"{STATE}, square bigint, hi bigint, height double"


class Merging:
    """Clusters of one square, in the order of their ids, merged as far as it is certain.

    ``starts`` are the first rows of the clusters in ``x, y, w``. ``box`` is the square
    as ``x0, x1, y0, y1``, None if nothing lies outside, where clusters have at least
    ``lightest`` crashes. After ``run``, ``root`` has the
    place of the cluster that each one became part of, and ``done`` says which of those
    have nothing within ``limit``.
    """

    def __init__(self, linkage: str, parts: list[np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, box: tuple | None, limit: float, lightest: int):
        self.linkage, self.x, self.y, self.w, self.box, self.limit, self.lightest = linkage, x, y, w.astype(float), box, limit, lightest
        self.at = np.arange(len(parts))
        self.root, self.parts = self.at.copy(), parts
        rows = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        total = lambda v: np.add.reduceat(v, starts)
        px, py, pw = x[rows], y[rows], self.w[rows]
        self.n = total(pw)
        # From a corner, so that sums keep all digits.
        x0, y0 = px.min(), py.min()
        self.cx, self.cy = x0 + total(pw * (px - x0)) / self.n, y0 + total(pw * (py - y0)) / self.n
        self.alive = np.ones(len(parts), bool)
        self.value, self.all = None, True
        if linkage != "ward":
            away = (px - np.repeat(self.cx, sizes)) ** 2 + (py - np.repeat(self.cy, sizes)) ** 2
            self.ss = total(pw * away)
            self.x0, self.y0 = np.minimum.reduceat(px, starts), np.minimum.reduceat(py, starts)
            self.x1, self.y1 = np.maximum.reduceat(px, starts), np.maximum.reduceat(py, starts)
            self.all = len(rows) <= MEASURED
            if self.all:
                d2 = (px[:, None] - px) ** 2 + (py[:, None] - py) ** 2
                value = d2 if linkage == "complete" else pw[:, None] * pw * np.sqrt(d2)
                if len(rows) > len(parts):
                    fold = np.maximum if linkage == "complete" else np.add
                    value = fold.reduceat(fold.reduceat(value, starts, axis=0), starts, axis=1)
                self.value = value
            else:
                self.value = np.full((len(parts), len(parts)), np.nan)
        # Infinite where a height is not known; ``least`` and ``most`` bound it there, and are infinite and the height where it is known.
        self.height = self.heights(slice(None))
        if not self.all:
            self.least, self.most = self.bounds(slice(None))
        for table in self.tables():
            np.fill_diagonal(table, np.inf)

    def tables(self) -> list[np.ndarray]:
        return [self.height] if self.all else [self.height, self.least, self.most]

    def gap2(self, of: np.ndarray | slice) -> np.ndarray:
        return (self.cx[of][:, None] - self.cx) ** 2 + (self.cy[of][:, None] - self.cy) ** 2

    def outside(self) -> np.ndarray:
        """The least height at which each cluster can be linked to one outside the square."""
        if self.box is None:
            return np.full(len(self.at), np.inf)
        x0, x1, y0, y1 = self.box
        way = np.minimum(np.minimum(self.cx - x0, x1 - self.cx), np.minimum(self.cy - y0, y1 - self.cy))
        if self.linkage == "ward":
            way = way * np.sqrt(2 * self.n * self.lightest / (self.n + self.lightest))
        return np.maximum(way, 0) * (1 - 1e-9) - 1e-2

    def bounds(self, of: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest height from some clusters to all by centroids, spreads and extents."""
        gap2 = self.gap2(of)
        if self.linkage == "average":
            spread = self.ss / self.n
            return np.sqrt(gap2) * (1 - 1e-9) - 1e-2, np.sqrt(gap2 + spread[of][:, None] + spread) * (1 + 1e-9) + 1e-2
        reach = lambda lo, hi: np.maximum(hi[of][:, None] - lo, hi - lo[of][:, None])
        across, along = reach(self.x0, self.x1), reach(self.y0, self.y1)
        return np.maximum(np.sqrt(gap2) * (1 - 1e-9), np.maximum(across, along)), np.hypot(across, along) * (1 + 1e-9)

    def measured(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The greatest squared distance, or the weighted sum of distances, from all positions of pairs of clusters."""
        a, b = [self.parts[k] for k in self.at[i]], [self.parts[k] for k in self.at[j]]
        na, nb = (np.array([len(p) for p in side], np.int64) for side in (a, b))
        ends, out, p = np.cumsum(na * nb), np.empty(len(a)), 0
        while p < len(a):
            # As many pairs as have few distances together.
            q = max(int(np.searchsorted(ends, (ends[p - 1] if p else 0) + TOGETHER, side="right")), p + 1)
            out[p:q] = self.one(a[p], b[p]) if q == p + 1 else self.several(a[p:q], b[p:q], na[p:q], nb[p:q])
            p = q
        return out

    def one(self, a: np.ndarray, b: np.ndarray) -> float:
        step, out = max(PAIRS // len(b), 1), 0.0
        for part in (a[k:k + step] for k in range(0, len(a), step)):
            d2 = (self.x[part][:, None] - self.x[b]) ** 2 + (self.y[part][:, None] - self.y[b]) ** 2
            out = max(out, float(d2.max())) if self.linkage == "complete" else out + float(self.w[part] @ np.sqrt(d2) @ self.w[b])
        return out

    def several(self, a: list[np.ndarray], b: list[np.ndarray], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        rows, across, n = np.concatenate(a), np.concatenate(b), na * nb
        # Every position of the one cluster with a stretch of all positions of the other.
        wide = np.repeat(nb, na)
        first = np.repeat(np.cumsum(nb) - nb, na)
        left = np.repeat(rows, wide)
        right = across[np.arange(len(left)) - np.repeat(np.cumsum(wide) - wide - first, wide)]
        d2 = (self.x[left] - self.x[right]) ** 2 + (self.y[left] - self.y[right]) ** 2
        starts = np.cumsum(n) - n
        return np.maximum.reduceat(d2, starts) if self.linkage == "complete" else np.add.reduceat(self.w[left] * np.sqrt(d2) * self.w[right], starts)

    def heights(self, of: np.ndarray | slice) -> np.ndarray:
        """From some clusters to all; infinite where it is not known."""
        if self.linkage == "ward":
            n = self.n
            return np.sqrt(2 * n[of][:, None] * n / (n[of][:, None] + n) * self.gap2(of))
        height = np.round(self.value[of] / (self.n[of][:, None] * self.n), 3) if self.linkage == "average" else np.sqrt(self.value[of])
        return height if self.all else np.where(np.isnan(height), np.inf, height)

    def ask(self, outside: np.ndarray) -> None:
        """Measure pairs that may be nearest ones below the limit and the way outside: first one of each cluster, as it may spare the others."""
        here = np.arange(len(self.at))
        while True:
            top = np.minimum(self.most.min(1), np.minimum(outside, self.limit))
            asked = (self.least <= top[:, None]) & (self.least < np.inf)
            some = np.flatnonzero(asked.any(1))
            if not len(some):
                break
            first = np.where(asked[some], self.least[some], np.inf).argmin(1)
            i, j = np.divmod(np.unique(np.minimum(here[some], first) * len(here) + np.maximum(here[some], first)), len(here))
            value = self.measured(i, j)
            self.value[i, j] = self.value[j, i] = value
            height = np.sqrt(value) if self.linkage == "complete" else np.round(value / (self.n[i] * self.n[j]), 3)
            for table, known in zip(self.tables(), (height, np.inf, height)):
                table[i, j] = table[j, i] = known

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``lo, hi, height`` of the merges, by place."""
        found = []
        while True:
            outside = self.outside()
            if not self.all:
                self.ask(outside)
            # The first of equals, so the pair of the lowest places.
            near = self.height.argmin(1)
            here = np.arange(len(near))
            best = self.height[here, near]
            sure = (best < outside) & (best <= self.limit) & (best < np.inf)
            lo = np.flatnonzero(sure & (near[near] == here) & sure[near] & (here < near))
            if not len(lo):
                self.done = ((best > self.limit) & (outside > self.limit))[self.alive]
                break
            hi = near[lo]
            found.append((self.at[lo], self.at[hi], best[lo]))
            self.merge(lo, hi)
            if self.alive.sum() < 0.7 * len(self.alive):
                self.close_up()
        self.close_up()
        at = np.full(len(self.root), -1)
        at[self.at] = self.at
        for a, b, _ in reversed(found):
            at[b] = at[a]
        self.root = at
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (here[:0], here[:0], best[:0])

    def merge(self, lo: np.ndarray, hi: np.ndarray) -> None:
        n, m = self.n[lo], self.n[hi]
        self.alive[hi] = False
        if self.linkage != "ward":
            apart = (self.cx[lo] - self.cx[hi]) ** 2 + (self.cy[lo] - self.cy[hi]) ** 2
            self.ss[lo] += self.ss[hi] + n * m / (n + m) * apart
            for v, fold in ((self.x0, np.minimum), (self.y0, np.minimum), (self.x1, np.maximum), (self.y1, np.maximum)):
                v[lo] = fold(v[lo], v[hi])
            # A pair of which a part is not known stays unknown.
            fold = np.maximum if self.linkage == "complete" else np.add
            value = self.value
            value[lo] = fold(value[lo], value[hi])
            value[:, lo] = fold(value[:, lo], value[:, hi])
            if not self.all:
                for a, b in zip(self.at[lo], self.at[hi]):
                    self.parts[a] = np.r_[self.parts[a], self.parts[b]]
        self.cx[lo], self.cy[lo] = (n * self.cx[lo] + m * self.cx[hi]) / (n + m), (n * self.cy[lo] + m * self.cy[hi]) / (n + m)
        self.n[lo] = n + m
        # Only what was merged has other heights; the dead are out of reach.
        height = self.heights(lo)
        rows = [height]
        if not self.all:
            known, (least, most) = height < np.inf, self.bounds(lo)
            rows += [np.where(known, np.inf, least), np.where(known, height, most)]
        for table, row in zip(self.tables(), rows):
            row[:, ~self.alive] = np.inf
            row[np.arange(len(lo)), lo] = np.inf
            table[lo], table[:, lo] = row, row.T
            table[hi], table[:, hi] = np.inf, np.inf

    def close_up(self) -> None:
        """Let go of what became part of other clusters."""
        keep, self.alive = self.alive, self.alive[self.alive]
        for name in ("cx", "cy", "n", "at", *(() if self.linkage == "ward" else ("ss", "x0", "y0", "x1", "y1"))):
            setattr(self, name, getattr(self, name)[keep])
        for name in ("height", *(() if self.linkage == "ward" else ("value",)), *(() if self.all else ("least", "most"))):
            setattr(self, name, getattr(self, name)[keep][:, keep])


def squares(codes: np.ndarray, first: int, last: int, size: int) -> Iterator[tuple[int, int, int, bool]]:
    """``(from, to, bits, whole)``: clusters by squares of at most ``size`` whose codes all lie between ``first`` and ``last``.

    Clusters that are in no such square come with ``whole`` False.
    """
    todo = [(0, MAP_BITS, 0, len(codes))]
    while todo:
        start, bits, i, j = todo.pop()
        if i == j:
            continue
        inside = first < start and start + (1 << 2 * bits) - 1 < last
        if bits == 0 or (inside and j - i <= size):
            yield i, j, bits, inside and j - i <= size
            continue
        step = 1 << 2 * (bits - 1)
        cuts = [i, *(i + np.searchsorted(codes[i:j], [start + step, start + 2 * step, start + 3 * step])).tolist(), j]
        todo += [(start + k * step, bits - 1, cuts[k], cuts[k + 1]) for k in range(4)]


def interleaved(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``geo.morton`` of whole numbers of at most ``MAP_BITS``."""
    out = np.zeros(len(x), np.int64)
    for shift, v in enumerate((x.astype(np.int64), y.astype(np.int64))):
        for bits, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | v << bits) & mask
        out |= v << shift
    return out


def outlines(x: np.ndarray, y: np.ndarray, w: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """``x, y, w`` with rows added at the end, and ``parts`` without positions that no greatest distance ends at.

    Those lie strictly within the eight sides between a cluster's outermost positions; one row at
    their mean stands for all of them.
    """
    sizes = np.array([len(p) for p in parts])
    rows, starts = np.concatenate(parts), np.cumsum(sizes) - sizes
    each = lambda v: np.repeat(v, sizes)
    x0, y0 = np.minimum.reduceat(x[rows], starts), np.minimum.reduceat(y[rows], starts)
    px, py = x[rows] - each(x0), y[rows] - each(y0)
    corners = []
    for dx, dy in ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)):
        far = dx * px + dy * py
        at = np.flatnonzero(far == each(np.maximum.reduceat(far, starts)))
        corners.append(at[np.searchsorted(at, starts)])
    inner = np.ones(len(rows), bool)
    for a, b in zip(corners, corners[1:] + corners[:1]):
        ax, ay, bx, by = (each(v) for v in (px[a], py[a], px[b], py[b]))
        # A whole number for positions as given, so half of one is no matter of rounding.
        inner &= ((bx - ax) * (py - ay) - (by - ay) * (px - ax) > 0.5) | ((ax == bx) & (ay == by))
    inner &= each(np.add.reduceat(inner, starts) > 1)
    some = np.flatnonzero(np.add.reduceat(inner, starts))
    if not len(some):
        return x, y, w, parts
    total = lambda v: np.add.reduceat(np.where(inner, v, 0), starts)[some]
    weight = total(w[rows])
    add = np.full(len(parts), -1)
    add[some] = len(x) + np.arange(len(some))
    x, y = (np.r_[v, low[some] + total(w[rows] * p) / weight] for v, low, p in ((x, x0, px), (y, y0, py)))
    left = np.split(rows[~inner], np.cumsum(sizes - np.add.reduceat(inner, starts))[:-1])
    return x, y, np.r_[w, weight], [p if k < 0 else np.r_[p, k] for p, k in zip(left, add.tolist())]


def merge_stretch(table: pa.Table, linkage: str, size: int, alone: bool, move: tuple[int, int], lightest: int) -> pa.Table:
    """The rows that are left, and the merges, of one task's rows in the order of group, code and id.

    What is left of the squares is cut into wider ones as long as that settles much.
    """
    ids, codes, x, y, w, cx, cy = (table[c].to_numpy() for c in ("id", "code", "x", "y", "w", "cx", "cy"))
    limits = table["limit"].fill_null(np.inf).to_numpy()
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    names = table["grp"].combine_chunks().dictionary_encode()
    group = names.indices.to_numpy()[starts]
    bounds = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
    place = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # The task before or after may hold more of the first and the last group.
    first = [-1 if alone or g > 0 else int(codes[starts[a]]) for g, a in enumerate(bounds[:-1])]
    last = [1 << 2 * MAP_BITS if alone or g < len(bounds) - 2 else int(codes[starts[b - 1]]) for g, b in enumerate(bounds[1:])]
    # One name for all merges of a group here, so that they are put together in one place.
    square, limits = ids[starts[bounds[:-1]]], limits[starts[bounds[:-1]]]
    parts = np.split(np.arange(len(ids)), starts[1:])
    ids, code, cx, cy = ids[starts], codes[starts], cx[starts].copy(), cy[starts].copy()
    if linkage == "ward":
        x, y, w = x.copy(), y.copy(), w.copy()
    live, merges, shifted = np.arange(len(starts)), [], (1 << MAP_BITS) - 1
    while True:
        stay, changed, made = np.ones(len(ids), bool), [], 0
        ends = np.searchsorted(place[live], np.arange(len(bounds)))
        for g, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            for i, j, bits, whole in squares(code[live[a:b]], first[g], last[g], size):
                if not whole:
                    continue
                own = live[a + i:a + j]
                own = own[np.argsort(ids[own])]
                corner = [min(max(int(v[own[0]]) + m, 0), shifted) >> bits << bits for v, m in ((cx, move[0]), (cy, move[1]))]
                box = None if bits == MAP_BITS else (corner[0] - move[0], corner[0] - move[0] + (1 << bits), corner[1] - move[1], corner[1] - move[1] + (1 << bits))
                task = Merging(linkage, [parts[k] for k in own], x, y, w, box, float(limits[g]), lightest)
                lo, hi, height = task.run()
                left = own[task.at]
                stay[own] = False
                stay[left[~task.done]] = True
                if not len(lo):
                    continue
                made += len(lo)
                merges.append((np.full(len(lo), group[bounds[g]]), ids[own[lo]], ids[own[hi]], height, np.full(len(lo), square[g])))
                cx[left], cy[left] = np.floor(task.cx).astype(np.int64), np.floor(task.cy).astype(np.int64)
                if linkage == "ward":
                    rows = np.array([parts[k][0] for k in left])
                    x[rows], y[rows], w[rows] = task.cx, task.cy, task.n.astype(np.int64)
                    continue
                order = np.argsort(task.root, kind="stable")
                for members in np.split(own[order], np.flatnonzero(np.diff(task.root[order])) + 1):
                    if len(members) > 1:
                        parts[members[0]] = np.concatenate([parts[k] for k in members])
                        changed.append(members[0])
        live = live[stay[live]]
        if linkage == "complete":
            wide = [k for k in changed if stay[k] and len(parts[k]) > OUTLINED]
            if wide:
                x, y, w, fewer = outlines(x, y, w, [parts[k] for k in wide])
                for k, rows in zip(wide, fewer):
                    parts[k] = rows
        if made <= len(live) * SETTLED or len(place) > len(live) * GROWN:
            break
        code[live] = interleaved(*(np.clip(v[live] + m, 0, shifted) for v, m in ((cx, move[0]), (cy, move[1]))))
        live = live[np.lexsort((ids[live], code[live], place[live]))]
    sizes = np.array([len(parts[k]) for k in live], np.int64)
    rows = np.concatenate([parts[k] for k in live]) if len(live) else live
    of, head = np.repeat(live, sizes), np.zeros(len(rows), bool)
    head[np.cumsum(sizes) - sizes] = True
    grp = names.dictionary
    rows = pa.table({"grp": grp.take(pa.array(group[of])), "id": ids[of], "x": x[rows], "y": y[rows], "w": w[rows], "cx": cx[of], "cy": cy[of], "head": head})
    if not merges:
        return rows
    g, lo, hi, height, square = (np.concatenate(c) for c in zip(*merges))
    return pa.concat_tables([rows, pa.table({"grp": grp.take(pa.array(g)), "id": lo, "square": square, "hi": hi, "height": height})], promote_options="default")


def round_of(state: DataFrame, limits: DataFrame | None, linkage: str, number: int, parts: int, size: int, lightest: int) -> DataFrame:
    """Rows ``FOUND`` of one round: merges have a ``square``, the rows of clusters that are left have none.

    No row of ``state`` has less than ``lightest`` crashes.
    """
    move = tuple(number * m % (1 << MOVE_BITS) for m in MOVES)
    fields = [f.split() for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            out = merge_stretch(pa.Table.from_batches(held), linkage, size, parts == 1, move, lightest)
            kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            columns = [out[n].cast(kinds[k]) if n in out.column_names else pa.nulls(out.num_rows, kinds[k]) for n, k in fields]
            yield from pa.table(columns, names=[n for n, _ in fields]).combine_chunks().to_batches(max_chunksize=1 << 16)

    # What lies off the map is held at its edge; that makes no way longer.
    held = lambda c, m: F.least(F.greatest(F.col(c) + m, F.lit(0)), F.lit((1 << MAP_BITS) - 1)).cast("bigint")
    rows = state.drop("head").withColumn("code", morton(held("cx", move[0]), held("cy", move[1])))
    rows = rows.withColumn("limit", F.lit(None).cast("double")) if limits is None else rows.join(F.broadcast(limits), "grp", "left")
    dealt = rows.repartition(1) if parts == 1 else rows.repartitionByRange(parts, "grp", "code", "id")
    return dealt.sortWithinPartitions("grp", "code", "id").mapInArrow(run, FOUND)


def roots_by_square(merges: DataFrame) -> DataFrame:
    """``(id, root)`` of the merges ``(square, lo, hi)`` of one round, which meet within their square only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, "square"):
            lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
            ids = np.unique(np.r_[lo, hi])
            root = np.arange(len(ids))
            # A cluster is merged into another once at most.
            root[np.searchsorted(ids, hi)] = np.searchsorted(ids, lo)
            while (root[root] != root).any():
                root = root[root]
            moved = root != np.arange(len(ids))
            yield pa.record_batch({"id": ids[moved], "root": ids[root[moved]]})

    return merges.select("square", "lo", "hi").repartition("square").sortWithinPartitions("square").mapInArrow(run, "id bigint, root bigint")
