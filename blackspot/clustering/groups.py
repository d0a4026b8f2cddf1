"""Flat cuts of many small groups of positions at once, in numpy arrays of groups x positions x positions.

A task takes whole groups, sorts them by size, and merges one pair of clusters in
every group of about the same size per step. A group costs the cube of its
positions in array elements, and no Python calls of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Groups of more positions are merged by themselves.
TOGETHER = 64
# Elements of one array of distances (4 MB).
ELEMENTS = 1 << 19
# Rows after which whole groups are handed on.
ROWS = 1 << 16
# In place of an id that is null.
NO_ID = np.iinfo(np.int64).max


def merges_together(x: np.ndarray, y: np.ndarray, w: np.ndarray, needed: np.ndarray, linkage: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lo, hi, height`` of step x group: the first ``needed`` merges of every group, and those that may be as low as the last.

    ``x, y, w`` are groups x positions; a place without a position has no weight.
    The height of a step without a merge is infinite.
    """
    count, size = x.shape
    cx, cy, n, alive = x.astype(float), y.astype(float), w.astype(float), w > 0
    gap2 = (cx[:, :, None] - cx[:, None, :]) ** 2 + (cy[:, :, None] - cy[:, None, :]) ** 2
    value = None
    with np.errstate(divide="ignore", invalid="ignore"):
        if linkage == "ward":
            height = np.sqrt(2 * n[:, :, None] * n[:, None, :] / (n[:, :, None] + n[:, None, :]) * gap2)
        elif linkage == "average":
            mass = n[:, :, None] * n[:, None, :]
            value = mass * np.sqrt(gap2)
            height = np.round(value / mass, 3)
        else:
            value, height = gap2, np.sqrt(gap2)
    height[~(alive[:, :, None] & alive[:, None, :]) | np.eye(size, dtype=bool)] = np.inf
    los, his, heights = [], [], []
    top, done = np.full(count, -np.inf), np.zeros(count, np.int64)
    while True:
        first = height.reshape(count, -1).argmin(1)
        lo, hi = first // size, first % size
        h = height[np.arange(count), lo, hi]
        go = (h < np.inf) & (needed > 0) & ((done < needed) | (h <= top * (1 + 1e-9)))
        if not go.any():
            break
        los.append(lo), his.append(hi), heights.append(np.where(go, h, np.inf))
        top, done = np.where(go & (done < needed), np.maximum(top, h), top), done + go
        g, a, b = np.flatnonzero(go), lo[go], hi[go]
        na, nb = n[g, a], n[g, b]
        alive[g, b] = False
        n[g, a] = na + nb
        if linkage == "ward":
            cx[g, a], cy[g, a] = (na * cx[g, a] + nb * cx[g, b]) / (na + nb), (na * cy[g, a] + nb * cy[g, b]) / (na + nb)
            row = np.sqrt(2 * n[g, a, None] * n[g] / (n[g, a, None] + n[g]) * ((cx[g, a, None] - cx[g]) ** 2 + (cy[g, a, None] - cy[g]) ** 2))
        else:
            join = {"average": np.add, "single": np.minimum, "complete": np.maximum}[linkage]
            row = join(value[g, a], value[g, b])
            value[g, a], value[g, :, a] = row, row
            with np.errstate(divide="ignore", invalid="ignore"):
                row = np.round(row / (n[g, a, None] * n[g]), 3) if linkage == "average" else np.sqrt(row)
        row[~alive[g]] = np.inf
        row[np.arange(len(g)), a] = np.inf
        height[g, a], height[g, :, a] = row, row
        height[g, b], height[g, :, b] = np.inf, np.inf
    empty = np.zeros((0, count))
    return (np.array(los), np.array(his), np.array(heights)) if los else (empty.astype(int), empty.astype(int), empty)


def roots_of(size: int, lo: np.ndarray, hi: np.ndarray, height: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Groups x positions: the first position of the cluster left by the ``needed`` lowest merges of a group, equal heights included."""
    root = np.tile(np.arange(size), (len(needed), 1))
    if not len(lo):
        return root
    limit = np.take_along_axis(np.sort(height, axis=0), np.maximum(needed - 1, 0)[None], axis=0)[0]
    for a, b, h in zip(lo, hi, height):
        g = np.flatnonzero((h <= limit) & (h < np.inf) & (needed > 0))
        rows = root[g]
        root[g] = np.where(rows == b[g, None], a[g, None], rows)
    return root


def cut_groups(starts: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, needed: np.ndarray, linkage: str,
               alone: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per position the first position of its cluster; group ``i`` has the positions from ``starts[i]`` up to ``starts[i + 1]``.

    ``alone(x, y, w)`` gives all merges of one group too large to be merged together with others.
    """
    sizes = np.diff(starts)
    root = np.arange(len(x))
    classes = np.where(sizes <= 8, sizes, (sizes + 3) // 4 * 4)
    classes[(needed <= 0) | (sizes < 2)] = 0
    for size in np.unique(classes[(classes > 0) & (sizes <= TOGETHER)]):
        groups = np.flatnonzero((classes == size) & (sizes <= TOGETHER))
        step = max(ELEMENTS // int(size) ** 2, 1)
        for some in (groups[i:i + step] for i in range(0, len(groups), step)):
            at = starts[some][:, None] + np.arange(size)
            held = np.arange(size) < sizes[some][:, None]
            safe = np.where(held, at, starts[some][:, None])
            merges = merges_together(x[safe], y[safe], np.where(held, w[safe], 0), needed[some], linkage)
            local = roots_of(size, *merges, needed[some])
            root[at[held]] = (starts[some][:, None] + local)[held]
    for group in np.flatnonzero((needed > 0) & (sizes > TOGETHER)):
        s = slice(starts[group], starts[group + 1])
        merges = [m[:, None] for m in alone(x[s], y[s], w[s])]
        root[s] = starts[group] + roots_of(int(sizes[group]), *merges, needed[group:group + 1])[0]
    return root


def numbered(starts: np.ndarray, root: np.ndarray, first_id: np.ndarray) -> np.ndarray:
    """Per position the number of its cluster, from 1 in every group by the first id in the cluster.

    ``NO_ID`` stands for no id; a cluster without any comes first, as a null does in Spark's order.
    """
    first = np.full(len(root), NO_ID)
    np.minimum.at(first, root, first_id)
    first[first == NO_ID] = np.iinfo(np.int64).min
    heads = np.flatnonzero(root == np.arange(len(root)))
    group = np.searchsorted(starts, heads, side="right") - 1
    order = np.lexsort((first[heads], group))
    number = np.empty(len(heads), np.int64)
    number[order] = np.arange(len(heads)) - np.searchsorted(group, group) + 1
    out = np.empty(len(root), np.int64)
    out[heads] = number
    return out[root]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the place of every group's first row and their end; rows of a group follow each other."""
    def bounds(table: pa.Table) -> np.ndarray:
        column = table[key].combine_chunks()
        new = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.r_[0, np.flatnonzero(new) + 1, len(column)]

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(held)
            starts = bounds(table)
            last = int(starts[-2])
            held, rows = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
            if last:
                yield table.slice(0, last), starts[:-1]
    if held:
        table = pa.Table.from_batches(held)
        yield table, bounds(table)
