"""Numpy helpers over the byte buffers of Arrow text columns.

Texts are taken in slabs of about ``SLAB`` bytes, so that the work arrays of a
task stay small whatever the batch; a longer text is a slab of its own.
Hashes of byte and word ranges are differences of running polynomial sums
modulo 2**64, so any range of a slab costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv, self.n = base, _inverse(base), 0
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, SLAB)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(self.n, b, np.uint64), dtype=np.uint64)])
                                  for b in (self.base, self.inv))
        return self.up, self.down


BYTES, WORDS, SECOND = Powers(int(BASE)), Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5)


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64; spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Running polynomial sums; ``range_hash`` reads ranges from them."""
    up, _ = powers.upto(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def range_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    return (total[end] - total[start]) * powers.upto(len(total))[1][start]


def slabs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    if texts.null_count:
        # A null may stand on bytes; an empty copy of it does not.
        texts = pa.array([x or b"" for x in texts.to_pylist()], pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[:n + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        size = np.diff(offsets)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLAB, "right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every text (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = sums(data.astype(np.uint64) + np.uint64(1), BYTES)
    return mix(range_hash(total, starts, ends, BYTES) + (ends - starts).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by block-wise running minima."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, rank)`` for ``counts[i]`` items of each owner ``i``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in some ``[start, end)``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, gram: int, powers: Powers):
    """Runs of windows that share their content-chosen anchor.

    A window is ``window`` consecutive symbols of one sequence, its anchor the
    gram of least mixed hash in it (the leftmost of equals). Equal windows have
    equal anchors at equal places. Returns for each run: its sequence, the place
    of its first window, the number of windows, the anchor's hash and place.
    Places count from the start of the slab.
    """
    n, per = len(hashes), window - gram + 1
    total = sums(hashes, powers)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    at = np.arange(n - gram + 1)
    key = mix(range_hash(total, at, at + gram, powers))
    # The leftmost least gram: high bits of the hash, then the place.
    bits = np.uint64(int(n).bit_length())
    ranked = (key >> bits << bits) | at.astype(np.uint64)
    least = (sliding_min(ranked, per) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    place = np.arange(len(least))
    size = np.diff(first)
    count = np.maximum(size - window + 1, 0)
    valid = np.zeros(len(least) + 1, np.int64)
    np.add.at(valid, np.minimum(first[:-1], len(least)), np.where(count > 0, 1, 0))
    np.add.at(valid, np.minimum(first[:-1] + count, len(least)), np.where(count > 0, -1, 0))
    place = place[np.cumsum(valid[:-1]) > 0]
    if not len(place):
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    own = least[place]
    new = np.ones(len(place), bool)
    new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(place)))
    start = place[head]
    return np.searchsorted(first, start, "right") - 1, start, run, key[own[head]], own[head]


def space_joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by a space, and where each starts (one more at the end)."""
    size = ends - starts
    at = np.append(0, np.cumsum(size + 1))
    out = np.full(int(at[-1]), 0x20, np.uint8)
    owner, rank = spread(size)
    out[at[owner] + rank] = data[starts[owner] + rank]
    return out, at


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[bytes]:
    """One text of space-joined words for each of the sequences that start at ``first``."""
    out, at = space_joined(data, starts, ends)
    text, cut = out.tobytes(), at[first].tolist()
    return [text[a:max(a, b - 1)] for a, b in zip(cut, cut[1:])]
