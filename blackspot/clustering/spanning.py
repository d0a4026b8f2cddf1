"""Shortest spanning forest of positions by tasks that take whole squares of the map.

Positions lie along a Z-order curve, and a task takes a stretch of it. It goes up the
aligned squares within the stretch, from those with few positions to the widest, and
joins the positions of a square by their shortest tree. A position can be linked beyond
the square only if, in some sector of 60 degrees, the border is not farther away than the
nearest position of that sector: of two in one sector the way to the farther one is the
longest side of a triangle. So a tree edge is certain if one of its two sides, made up of
all shorter edges, cannot leave the square on a shorter way. Certain edges join their
positions for good. Only positions that may still be linked beyond the square, and the
ends of edges that are not certain, go on to wider squares: they lie along the border.
The next round has fewer rows and longer stretches; its squares hold whole ones of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from blackspot.clustering.groups import whole_groups
from blackspot.runtime import cut

#: Positions of a square that are joined without looking at the squares within it.
LEAF = 512
#: Rows that one task takes along the curve.
ROWS = 1 << 15
#: Level of the square that is the whole map; a square has sides of 2^level.
TOP = 31
#: Pairs of positions measured at once.
PAIRS = 1 << 19
#: Squared distance beyond all others.
FAR = 1 << 62

SECTORS = [f"s{k}" for k in range(6)]
STATE = ["id", "x", "y", "z", "comp", "q", "level", *SECTORS]
EDGES = ["square", "a", "b", "height", "sure"]


def shortest_tree(x: np.ndarray, y: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, d2)``: the shortest edges that join positions of which those of one ``comp``, from 0, are joined already."""
    n = len(x)
    at, x, y, comp = np.arange(n), x.copy(), y.copy(), comp.copy()
    many = np.bincount(comp) > 1
    best, via = np.full(n, FAR), np.zeros(n, np.int64)
    dx, dy = np.empty(n, np.int64), np.empty(n, np.int64)
    less = np.empty(n, bool)
    a, b, d2 = [], [], []
    take = 0
    for m in range(n - 1, -1, -1):
        i, px, py, c = int(at[take]), x[take], y[take], int(comp[take])
        if 0 < best[take] < FAR:
            a.append(int(via[take]))
            b.append(i)
            d2.append(int(best[take]))
        # The last row takes the place of the one that leaves.
        for column in (at, x, y, comp, best, via):
            column[take] = column[m]
        if not m:
            break
        u, v, l, k = dx[:m], dy[:m], less[:m], best[:m]
        np.subtract(x[:m], px, out=u)
        np.multiply(u, u, out=u)
        np.subtract(y[:m], py, out=v)
        np.multiply(v, v, out=v)
        np.add(u, v, out=u)
        np.less(u, k, out=l)
        np.copyto(via[:m], i, where=l)
        np.minimum(u, k, out=k)
        if many[c]:
            many[c] = False
            k[comp[:m] == c] = 0
        take = int(k.argmin())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(d2, np.int64)


def nearest_by_sector(x: np.ndarray, y: np.ndarray, asking: np.ndarray) -> np.ndarray:
    """Squared distance from the positions ``asking`` to the nearest other one in each of six sectors, counted from the x axis."""
    out = np.full((6, len(asking)), FAR)
    step = max(PAIRS // max(len(x), 1), 1)
    for i in range(0, len(asking), step):
        rows = asking[i:i + step]
        dx, dy = x - x[rows][:, None], y - y[rows][:, None]
        east, upper = dx > 0, dy > 0
        upper |= (dy == 0) & east
        dx *= dx
        dy *= dy
        d2 = dx + dy
        d2[d2 == 0] = FAR
        dx *= 3
        # No whole numbers lie at 60 degrees.
        steep = dy > dx
        sector = np.where(upper, np.where(steep, 1, np.where(east, 0, 2)), np.where(steep, 4, np.where(east, 5, 3))).astype(np.int8)
        for k in range(6):
            out[k, i:i + step] = np.where(sector == k, d2, FAR).min(axis=1)
    return out


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below ``n`` that each is joined to by the edges ``a, b``."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
    return root


class Stretch:
    """The rows of one task in the order of the curve, joined as far as it is certain.

    ``comp`` is the smallest id a position is joined to, ``q`` and ``level`` are the
    start and the level of the square it was joined in. No edge above the squared
    distance ``limit`` is needed. With ``whole`` there are no other rows.
    """

    def __init__(self, table: pa.Table, limit: int | None, whole: bool):
        take = lambda name: table[name].to_numpy().copy()
        self.ids, self.x, self.y, self.z, self.comp, self.q, self.level = (take(c) for c in STATE[:7])
        self.near = np.stack([take(c) for c in SECTORS])
        self.limit, self.whole = FAR if limit is None else limit, whole
        self.first, self.last = (0, (1 << 2 * TOP) - 1) if whole else (int(self.q.min()), int((self.q + (1 << 2 * self.level)).max()) - 1)
        self.sure: list[tuple] = []

    def ways_out(self, rows: np.ndarray, level: int) -> np.ndarray:
        """No more than the squared distance to the border of the square, by sector."""
        side = 1 << level
        x, y = (self.x[rows] & (side - 1)).astype(float), (self.y[rows] & (side - 1)).astype(float)
        west, east, south, north = x + 1, side - x, y + 1, side - y
        slant = 0.75 ** 0.5
        out = [np.minimum(east, north / slant), np.minimum(north, 2 * np.minimum(east, west)), np.minimum(west, north / slant),
               np.minimum(west, south / slant), np.minimum(south, 2 * np.minimum(east, west)), np.minimum(east, south / slant)]
        return np.floor(np.minimum(np.stack(out) ** 2 * (1 - 1e-9), 4e18)).astype(np.int64)

    def border(self, rows: np.ndarray, level: int) -> np.ndarray:
        """No more than the shortest squared distance at which each position may be linked beyond the square; ``FAR`` if it cannot be."""
        if self.whole and level == TOP:
            return np.full(len(rows), FAR)
        out = self.ways_out(rows, level)
        may = lambda: out <= np.minimum(self.near[:, rows], self.limit)
        asking = np.flatnonzero(may().any(axis=0))
        found = nearest_by_sector(self.x[rows], self.y[rows], asking)
        self.near[:, rows[asking]] = np.minimum(self.near[:, rows[asking]], found)
        return np.where(may(), out, FAR).min(axis=0)

    def join(self, rows: np.ndarray, start: int, level: int) -> tuple[np.ndarray, list[tuple]]:
        """The rows of a square that go on, and the edges among them that are not certain."""
        names, comp = np.unique(self.comp[rows], return_inverse=True)
        a, b, d2 = shortest_tree(self.x[rows], self.y[rows], comp)
        order = np.argsort(d2, kind="stable")
        order = order[d2[order] <= self.limit]
        a, b, d2 = a[order], b[order], d2[order]
        border = self.border(rows, level)
        least = np.full(len(names), FAR)
        np.minimum.at(least, comp, border)
        least, up, sure = least.tolist(), list(range(len(names))), np.zeros(len(a), bool)
        for e, (u, v, w) in enumerate(zip(comp[a].tolist(), comp[b].tolist(), d2.tolist())):
            while up[u] != u:
                up[u] = u = up[up[u]]
            while up[v] != v:
                up[v] = v = up[up[v]]
            sure[e] = least[u] > w or least[v] > w
            up[v], least[u] = u, min(least[u], least[v])
        self.comp[rows] = names[joined(len(names), comp[a[sure]], comp[b[sure]])][comp]
        edges = lambda which: (self.ids[rows[a[which]]], self.ids[rows[b[which]]], d2[which])
        self.sure.append(edges(sure))
        open_ = edges(~sure)
        left = border < FAR
        left[a[~sure]] = left[b[~sure]] = True
        rows = rows[left]
        self.q[rows], self.level[rows] = start, level
        return rows, [open_]

    def solve(self, start: int, level: int, lo: int, hi: int) -> tuple[np.ndarray, list[tuple]]:
        """``join`` of the square, or of the widest squares within it that have no rows elsewhere."""
        rows = np.arange(lo, hi)
        if hi == lo or self.level[lo] >= level:
            return rows, []
        size = 1 << 2 * level
        own, top = self.first <= start and start + size - 1 <= self.last, self.whole and level == TOP
        if own and hi - lo == 1 and not top:
            return rows, []
        if own and hi - lo <= LEAF:
            return self.join(rows, start, level)
        starts = [start + k * (size >> 2) for k in range(4)]
        ends = [lo, *(lo + np.searchsorted(self.z[lo:hi], starts[1:])).tolist(), hi]
        parts = [self.solve(s, level - 1, l, h) for s, l, h in zip(starts, ends[:-1], ends[1:]) if l < h]
        rows, edges = np.concatenate([r for r, _ in parts]), [e for _, more in parts for e in more]
        return self.join(rows, start, level) if own and (len(parts) > 1 or top) else (rows, edges)

    def result(self) -> pa.Table:
        rows, edges = self.solve(0, TOP, 0, len(self.ids))
        left = [self.ids, self.x, self.y, self.z, self.comp, self.q, self.level, *self.near]
        columns = {n: pa.array(c[rows]) for n, c in zip(STATE, left)}
        blocks = [pa.table(columns)]
        for held, sure in ((self.sure, True), (edges, False)):
            if held:
                a, b, height = (np.concatenate(c) for c in zip(*held))
                blocks.append(pa.table({"square": np.full(len(a), self.ids[0]), "a": a, "b": b, "height": height, "sure": np.full(len(a), sure)}))
        return pa.concat_tables(blocks, promote_options="default")


def forest_round(state: DataFrame, limit: int | None, parts: int) -> DataFrame:
    """Rows of one round: edges have a ``square``, positions that go on have none."""
    names = [*STATE, *EDGES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            out = Stretch(pa.Table.from_batches(held), limit, parts == 1).result()
            kind = lambda n: pa.bool_() if n == "sure" else pa.int64()
            columns = [out[n].cast(kind(n)) if n in out.column_names else pa.nulls(out.num_rows, kind(n)) for n in names]
            yield from pa.table(columns, names=names).combine_chunks().to_batches(max_chunksize=1 << 16)

    # A square has one start, so its rows stay together.
    dealt = state.repartition(1) if parts == 1 else state.repartitionByRange(parts, "q")
    schema = ", ".join(f"{n} {'boolean' if n == 'sure' else 'bigint'}" for n in names)
    return dealt.sortWithinPartitions("z").mapInArrow(run, schema)


def forest_start(spots: DataFrame) -> DataFrame:
    """The first state of positions ``(id, x, y, z)``, every one a square of its own."""
    fixed = lambda n: F.lit(n).cast("bigint")
    return spots.select("id", "x", "y", "z", F.col("id").alias("comp"), F.col("z").alias("q"), fixed(0).alias("level"),
                        *[fixed(FAR).alias(s) for s in SECTORS])


def joined_by_square(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of positions joined to a smaller one by edges ``(square, a, b)``, which meet within their square only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, "square"):
            ends = np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()])
            ids, at = np.unique(ends, return_inverse=True)
            root = joined(len(ids), *np.split(at, 2))
            moved = root != np.arange(len(ids))
            yield pa.record_batch({"id": ids[moved], "root": ids[root[moved]]})

    return edges.select("square", "a", "b").repartition("square").sortWithinPartitions("square").mapInArrow(run, "id bigint, root bigint")


def joined_by_rounds(rounds: list[DataFrame]) -> DataFrame:
    """``(id, root)`` of positions joined to a smaller one by the edges ``(square, a, b)`` of all rounds.

    What one round joined lies within one square of the next, where it goes by the name of its smallest id.
    """
    roots = None
    for edges in rounds:
        if roots is None:
            roots = cut(joined_by_square(edges))
            continue
        # Few positions went on to this round.
        asked = edges.select(F.col("a").alias("id")).unionAll(edges.select("b")).distinct()
        names = cut(roots.join(asked, "id"))
        name = lambda key: names.select(F.col("id").alias(key), F.col("root").alias(f"{key}_root"))
        named = edges.join(name("a"), "a", "left").join(name("b"), "b", "left")
        own = cut(joined_by_square(named.select("square", F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))))
        later = own.select(F.col("id").alias("root"), F.col("root").alias("last"))
        roots = cut(roots.join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root")).unionAll(own), replaces=roots)
    return roots
