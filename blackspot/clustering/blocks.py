"""Searches within a radius by tasks that take whole squares of the map, each with the positions around it.

A square holds 32 x 32 cells; one with more than ``LIMIT`` positions in and around
it is divided into 4 x 4, twice at most. What is still crowded then is left to
trees of boxes (``boxtree``). So every position travels to its square and, near a
border, to the next ones, instead of meeting its cell's 24 neighbours in joins.
Within a task positions lie in strips, sorted along them: of every strip the stretch
that is surely within the radius is settled by running sums, and only positions
between near and far are measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from blackspot.clustering.groups import whole_groups
from blackspot.runtime import cut

#: Positions in and around a square that one task takes at once.
LIMIT = 1 << 15
#: Sides of the squares, in bits above the side of a cell.
LEVELS = (5, 3, 1)
#: Pairs that are measured at once.
PAIRS = 1 << 20


def block_of(level: int, bx: str = "bx", by: str = "by") -> Column:
    return F.expr(f"shiftleft(shiftleft({bx} + 1L, 29) | ({by} + 1L), 4) | {level}L")


def deal(spots: DataFrame, bits: int, radius: int) -> tuple[DataFrame, DataFrame | None]:
    """``spots`` with ``block`` once per square that they are in (``home``) or around, and the ``spots`` in crowded squares, if any."""
    def seen(level: int) -> DataFrame:
        touched = lambda c: F.explode(F.expr(f"sequence(shiftright({c} - {radius}L, {bits + level}), shiftright({c} + {radius}L, {bits + level}))"))
        return (spots.withColumn("bx", touched("x")).withColumn("by", touched("y"))
                .withColumns({"block": block_of(level), "home": F.expr(f"bx = shiftright(x, {bits + level}) and by = shiftright(y, {bits + level})")}))

    parts, crowded, above = [], None, 0
    for level in LEVELS:
        rows = seen(level)
        if crowded is not None:
            up = above - level
            rows = rows.withColumn("_parent", block_of(above, f"shiftright(bx, {up})", f"shiftright(by, {up})"))
            rows = rows.join(F.broadcast(crowded.withColumnRenamed("block", "_parent")), "_parent", "left_semi").drop("_parent")
        sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any"))
        # Fewer than sixteen per LIMIT positions.
        crowded, above = cut(sizes.filter((F.col("n") > LIMIT) & F.col("any")).select("block")), level
        if crowded.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(F.broadcast(crowded), "block", "left_anti"))
    dealt = reduce(DataFrame.unionByName, [p.drop("bx", "by") for p in parts])
    if crowded.isEmpty():
        return dealt, None
    own = spots.withColumn("block", block_of(above, f"shiftright(x, {bits + above})", f"shiftright(y, {bits + above})"))
    return dealt, own.join(F.broadcast(crowded), "block", "left_semi").drop("block")


def by_block(dealt: DataFrame, look: Callable[..., pa.Table], schema: T.StructType) -> DataFrame:
    """Rows that ``look(table, starts)`` gives for tables of whole blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, "block"):
            yield from look(table, starts).combine_chunks().to_batches()

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def stretches(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the number of a stretch and a place from ``lo`` to before ``hi`` in it, about ``PAIRS`` at a time."""
    sizes = np.maximum(hi - lo, 0)
    some = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[some])
    at = 0
    while at < len(some):
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)), at + 1)
        part = some[at:upto]
        n = sizes[part]
        yield np.repeat(part, n), np.arange(n.sum()) + np.repeat(lo[part] - np.cumsum(n) + n, n)
        at = upto


class Strips:
    """Positions of several blocks in strips as high as half a cell, sorted by block, strip and ``x``.

    ``order`` are their rows as given; places are places in that order. ``block``
    numbers the blocks below ``blocks``.
    """

    def __init__(self, block: np.ndarray, x: np.ndarray, y: np.ndarray, blocks: int, bits: int, radius: int):
        self.radius, self.shift = radius, max(bits - 1, 0)
        self.reach = (radius >> self.shift) + 1
        strip = y >> self.shift
        self.x_from, self.strip_from = np.full(blocks, np.iinfo(np.int64).max), np.full(blocks, np.iinfo(np.int64).max)
        np.minimum.at(self.x_from, block, x)
        np.minimum.at(self.strip_from, block, strip)
        empty = self.x_from == np.iinfo(np.int64).max
        self.x_from[empty], self.strip_from[empty] = 0, 0
        self.wide = int((x - self.x_from[block]).max(initial=0)) + 1
        self.high = int((strip - self.strip_from[block]).max(initial=0)) + 1
        line = block * self.high + strip - self.strip_from[block]
        key = line * self.wide + x - self.x_from[block]
        self.order = np.argsort(key, kind="stable")
        self.key, self.line, self.x, self.y = key[self.order], line[self.order], x[self.order], y[self.order]

    def near(self, block: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per strip in reach: the places from ``lo`` to before ``hi`` that may be near to each position asked for, and those among them that surely are."""
        strip, at = y >> self.shift, x - self.x_from[block]
        place = lambda line, where, side: np.searchsorted(self.key, line * self.wide + np.clip(where, 0, self.wide - 1), side)
        half = lambda gap: np.where(gap <= self.radius, whole_root(np.maximum(self.radius ** 2 - gap * gap, 0)), -1)
        for d in range(-self.reach, self.reach + 1):
            low = (strip + d) << self.shift
            high = low + (1 << self.shift) - 1
            line = strip + d - self.strip_from[block]
            held = (line >= 0) & (line < self.high)
            line = block * self.high + np.clip(line, 0, self.high - 1)

            def stretch(width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                lo, hi = place(line, at - width, "left"), place(line, at + width, "right")
                return lo, np.where(held & (width >= 0) & (at - width < self.wide) & (at + width >= 0), hi, lo)

            lo, hi = stretch(half(np.maximum(np.maximum(low - y, y - high), 0)))
            sure_lo, sure_hi = stretch(half(np.maximum(np.abs(low - y), np.abs(high - y))))
            none = sure_lo >= sure_hi
            yield lo, hi, np.where(none, lo, sure_lo), np.where(none, lo, sure_hi)

    def measured(self, x: np.ndarray, y: np.ndarray, *parts: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the number of a position asked for and a place in one of its stretches ``(lo, hi)`` that are within the radius."""
        for lo, hi in parts:
            for i, j in stretches(lo, hi):
                near = (x[i] - self.x[j]) ** 2 + (y[i] - self.y[j]) ** 2 <= self.radius ** 2
                yield i[near], j[near]


def whole_root(squares: np.ndarray) -> np.ndarray:
    """The whole part of the square root, exactly."""
    root = np.sqrt(squares.astype(float)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) ** 2 <= squares)


def weights(dealt: DataFrame, bits: int, radius: int) -> DataFrame:
    """Positions at home with the ``weight`` of all within ``radius``."""
    names = [n for n in dealt.columns if n not in ("block", "home")]
    schema = T.StructType([dealt.schema[n] for n in names] + [T.StructField("weight", T.LongType())])

    def look(table: pa.Table, starts: np.ndarray) -> pa.Table:
        block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        x, y, w = (table[c].to_numpy() for c in "xyw")
        strips = Strips(block, x, y, len(starts) - 1, bits, radius)
        w = w[strips.order]
        # Asked for in the order of the strips, so that searches stay close to each other.
        asked = strips.order[table["home"].to_numpy()[strips.order]]
        running, found = np.r_[0, np.cumsum(w)], np.zeros(len(asked), np.int64)
        for lo, hi, sure_lo, sure_hi in strips.near(block[asked], x[asked], y[asked]):
            found += running[sure_hi] - running[sure_lo]
            for i, j in strips.measured(x[asked], y[asked], (lo, sure_lo), (sure_hi, hi)):
                np.add.at(found, i, w[j])
        return table.select(names).take(pa.array(asked)).append_column("weight", pa.array(found))

    return by_block(dealt, look, schema)


def links(dealt: DataFrame, bits: int, radius: int) -> DataFrame:
    """``(cell, root, x, y)``: cells with core positions within ``radius`` of each other, and the cells whose core positions others reach.

    ``dealt`` has ``cell`` and ``core``. A row with a null ``x`` says that two cells
    belong together; the cells that a block joins are all tied to one of them, so
    there is at most one such row per block and cell. Other rows give a position
    at home that is not core itself the ``root`` of cells in reach.
    """

    def look(table: pa.Table, starts: np.ndarray) -> pa.Table:
        block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        x, y, cell = (table[c].to_numpy() for c in ("x", "y", "cell"))
        core, home = table["core"].to_numpy(), table["home"].to_numpy()
        # The cells of every block by number, in the order of blocks.
        by_cell = np.lexsort((cell, block))
        new = np.r_[True, (cell[by_cell][1:] != cell[by_cell][:-1]) | (block[by_cell][1:] != block[by_cell][:-1])]
        cells, count = cell[by_cell][new], int(new.sum())
        node = np.empty(len(cell), np.int64)
        node[by_cell] = np.cumsum(new) - 1
        held = np.flatnonzero(core)
        strips = Strips(block[held], x[held], y[held], len(starts) - 1, bits, radius)
        at = node[held][strips.order]
        # Places of one cell that follow each other in a strip are a run.
        begins = np.r_[True, (at[1:] != at[:-1]) | (strips.line[1:] != strips.line[:-1])][:len(at)]
        run, of_run = np.cumsum(begins) - 1, at[begins]
        asked = np.flatnonzero(home)
        asked = asked[np.lexsort((x[asked], y[asked] >> strips.shift, block[asked]))]
        pairs = [np.zeros(0, np.int64)]
        for lo, hi, sure_lo, sure_hi in strips.near(block[asked], x[asked], y[asked]) if len(held) else ():
            some = np.flatnonzero(sure_lo < sure_hi)
            for i, r in stretches(run[sure_lo[some]], run[sure_hi[some] - 1] + 1):
                pairs.append(some[i] * count + of_run[r])
            for i, j in strips.measured(x[asked], y[asked], (lo, sure_lo), (sure_hi, hi)):
                # The same pair follows itself mostly.
                found = i * count + at[j]
                pairs.append(found[np.r_[True, found[1:] != found[:-1]][:len(found)]])
        i, n = np.divmod(np.concatenate(pairs), count)
        inner = core[asked][i]
        edges = np.unique(node[asked][i[inner]] * count + n[inner])
        root = least_linked(*np.divmod(edges, count), count)
        tied = np.flatnonzero(root != np.arange(count))
        reached = np.unique(i[~inner] * count + root[n[~inner]])
        lone, to = asked[reached // count], cells[reached % count]
        return pa.table({"cell": np.r_[cells[tied], to], "root": np.r_[cells[root[tied]], to],
                         "x": pa.concat_arrays([pa.nulls(len(tied), pa.int64()), pa.array(x[lone])]),
                         "y": pa.concat_arrays([pa.nulls(len(tied), pa.int64()), pa.array(y[lone])])})

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("cell", "root", "x", "y")])
    # Positions that are not core matter only at home.
    return by_block(dealt.filter("core or home").select("block", "x", "y", "cell", "core", "home"), look, schema)


def least_linked(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Per node the smallest one of its component."""
    root = np.arange(count)
    while True:
        u, v = root[a], root[b]
        if (u == v).all():
            return root
        least = np.minimum(u, v)
        np.minimum.at(root, u, least)
        np.minimum.at(root, v, least)
        while (root[root] != root).any():
            root = root[root]
