"""Suffix-array dedup by difference-cover blockwise construction.

Every byte covered by a ``length``-byte string that starts in two places of the
corpus is removed. Only starts whose anchor (``arrays.anchors``) occurs twice can
be such places; the text around them is dealt out by anchor, so that all suffixes
that may agree on ``length`` bytes meet in one bucket.

A task takes its buckets in blocks of about 2 MB and sorts the
suffixes of a bucket on their own, to a depth of ``length``. Places at residues
of a difference cover are the sample: for any two places some shift below the
period takes both to sample places. Their ranks are computed beforehand by
prefix doubling in steps of the period. Two suffixes are then compared in a fixed
number of look-ups however long they agree: the first bytes, two sample ranks, and
the last bytes. Buckets are split by ternary partition around a pivot, all buckets
of a block at a time; suffixes equal to another to full depth are repeated.

Anchors that occur very often would fill a bucket without bound; their runs are
thinned out first (``repeats``). Texts of runs that are equal as a whole are
settled by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from blackspot.llm.arrays import spread
from blackspot.llm.common import documents, id_back, stored
from blackspot.llm.repeats import (BYTE_UNIT, PLACE_BITS, bytes_of, copies, each_slab, numbered, record, repeated_spans, runs, span_cover,
                                   unpack, with_spans)

LENGTH = 400
GRAM = 64
#: A perfect difference set: every residue is a difference of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)


def shifts() -> np.ndarray:
    """``[a, b]``: the least shift that takes residues ``a`` and ``b`` both into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    r = np.arange(PERIOD)
    out = np.full((PERIOD, PERIOD), -1)
    for d in range(PERIOD - 1, -1, -1):
        out[np.ix_(inside[(r + d) % PERIOD], inside[(r + d) % PERIOD])] = d
    assert (out >= 0).all()
    return out


SHIFT = shifts()


def dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


class Block:
    """Comparison of places of a text to a fixed depth."""

    def __init__(self, text: np.ndarray, length: int):
        self.length, n = length, len(text)
        padded = np.append(text, np.zeros(length + 8 * PERIOD, np.uint8))
        self.word = np.ndarray((len(padded) - 8,), ">u8", padded, strides=(1,))
        # Sample places in order; place p has number COVER-index + (p // PERIOD) * |COVER|.
        cover = np.array(COVER)
        places = (np.arange(n // PERIOD + 1)[:, None] * PERIOD + cover).ravel()
        number = np.full(PERIOD, -1)
        number[cover] = np.arange(len(cover))
        self.number = number
        self.rank = np.zeros(len(places), np.uint64)
        for k in (0, 8, 16, PERIOD - 8):
            self.rank = dense(self.rank << np.uint64(32) | dense(self.at(np.minimum(places + k, len(self.word) - 1))))
        self.depth = PERIOD
        # Both look-ups of a comparison start below the period and must end within the string.
        while 2 * self.depth <= length - PERIOD:
            step = self.depth // PERIOD * len(cover)
            after = np.zeros(len(self.rank), np.uint64)
            after[:-step or None] = self.rank[step:] + np.uint64(1) if step < len(self.rank) else 0
            self.rank = dense(self.rank << np.uint64(32) | after)
            self.depth *= 2
        self.rank = self.rank.astype(np.int64)

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.word[place].astype(np.uint64)

    def sample(self, place: np.ndarray) -> np.ndarray:
        return self.rank[place // PERIOD * len(COVER) + self.number[place % PERIOD]]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the strings at ``a`` are less than, equal to or greater than those at ``b``."""
        out = np.zeros(len(a), np.int8)

        todo = np.arange(len(a))

        def settle(x, y):
            """Decides by ``x`` and ``y``; says which stay open."""
            nonlocal todo
            side = (x > y).astype(np.int8) - (x < y)
            out[todo] = side
            todo = todo[side == 0]
            return side == 0

        for k in (0, 8, 16, PERIOD - 8):
            settle(self.at(a[todo] + k), self.at(b[todo] + k))
        # Sample places, each within the depth of the one before, up to the last that ends within the string.
        at = SHIFT[a[todo] % PERIOD, b[todo] % PERIOD]
        while True:
            at = at[settle(self.sample(a[todo] + at), self.sample(b[todo] + at))]
            step = np.minimum(self.depth, (self.length - self.depth - at) // PERIOD * PERIOD)
            if not (step > 0).any():
                break
            at = at + step
        for k in (PERIOD, PERIOD - 8, PERIOD - 16, 8):
            settle(self.at(a[todo] + self.length - k), self.at(b[todo] + self.length - k))
        return out


def repeated(block: Block, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which of the suffixes at ``place`` equal another of their bucket to full depth."""
    out = np.zeros(len(place), bool)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    while len(order):
        # Buckets of one suffix are done.
        new = np.append(True, bucket[1:] != bucket[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(order)))
        some = np.repeat(size > 1, size)
        order, bucket = order[some], bucket[some]
        if not len(order):
            break
        new = np.append(True, bucket[1:] != bucket[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(order)))
        pivot = np.repeat(order[head + size // 2], size)
        side = block.compare(place[order], place[pivot])
        number = np.repeat(np.arange(len(head)), size)
        equal = side == 0
        out[order[equal]] = np.repeat(np.bincount(number[equal], minlength=len(head)) > 1, np.bincount(number[equal], minlength=len(head)))
        rest = ~equal
        order, bucket = order[rest], (2 * number + (side > 0))[rest]
        again = np.argsort(bucket, kind="stable")
        order, bucket = order[again], bucket[again]
    return out


def sort_block(length: int):
    """Spans ``(doc, s, e)`` of strings that stand in two places of the buckets of a block."""
    def run(t: pa.RecordBatch) -> pa.RecordBatch:
        key, doc, packed = (t[c].to_numpy() for c in ("key", "doc", "run"))
        place, count, anchor = unpack(packed)
        data, offset = bytes_of(t)
        owner, rank = spread(count)
        # A bucket: the same anchor at the same place of the string.
        where = (anchor[owner] - rank).astype(np.int64)
        number = np.unique(key, return_inverse=True)[1]
        hit = repeated(Block(data, length), offset[owner] + rank, number[owner] * (1 << PLACE_BITS) + where)
        a, b = runs(hit, owner)
        return record("doc s e", doc[owner[a]], place[owner[a]] + rank[a], place[owner[a]] + rank[b] + length)
    return run


def remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offsets in each_slab(b):
                copied = lambda p: p["head"].is_valid().to_numpy(zero_copy_only=False)
                gone = span_cover(part, offsets, len(data), length, copied)
                removed = np.append(0, np.cumsum(gone))
                owner = np.repeat(np.arange(len(part)), np.diff(offsets))
                a, z = runs(gone, owner)
                kept, at = data[~gone].tobytes(), (offsets - removed[offsets]).tolist()
                ends = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(a, offsets).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(a - offsets[owner[a]]), pa.array(z + 1 - offsets[owner[a]])], names=["s", "e"]))
                yield record("doc_id n_bytes spans kept", part["doc_id"], np.diff(offsets), ends,
                             pa.array([kept[i:j] for i, j in zip(at, at[1:])], pa.binary()))
    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every row of ``docs`` without the bytes of ``length``-byte strings that start in two places.

    Texts count as UTF-8 bytes, and strings do not cross documents. Returns
    ``doc_id, n_bytes, spans, kept``: the maximal removed runs as (start, end) and
    the remaining bytes, which need not be UTF-8. A null or short text loses
    nothing; a text that occurs in two rows is removed whole in both if it is
    long enough. Other columns are not read; an empty table gives no rows.
    """
    if not PERIOD * 3 <= length < 1 << PLACE_BITS or not 8 <= gram <= length:
        raise ValueError("length must be from 93 to 1023 bytes and gram from 8 to length")
    rows = numbered(docs)
    twins = copies(rows)
    spans = repeated_spans(rows, twins, BYTE_UNIT, length, gram, True, sort_block(length))
    out = with_spans(rows, spans, twins).select("doc", "doc_id", "text", "head", "spans")
    return out.mapInArrow(remove(length), "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(documents(spark, sf_dir))
    return stored(kept.select(id_back(F.col("doc_id")).alias("doc_id"), "n_bytes",
                              (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                              F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
