"""What the two operators on repeated passages share.

Both look for windows of a fixed number of symbols (bytes, or words) that repeat in
the corpus. Every window has an anchor chosen by its content (``arrays.anchors``),
so equal windows have equal anchors at equal places, and a window whose anchor
occurs once in the corpus is unique. A run is all neighbouring windows with one
anchor; the text around runs of a repeated anchor is dealt out by the anchor, and
the windows of a bucket are compared in one task.

An anchor with more than ``CROWD`` places would fill that task. Its runs are split
by where the anchor stands in the window: all windows in which that place lies
in one range share more of their text than the anchor, and this longer text is the
finer key. Equal parts are reduced to the first of them over the whole corpus, and
parts whose finer key is unique are done. What is still crowded is split again, in
the end into single windows, which are equal if their keys are. A part is split
only where it reaches past what it shares with others, so a run costs a few rows
per round, however large its group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from blackspot.joins import split_join
from blackspot.llm.arrays import BYTES, SECOND, WORDS, Powers, anchors, covered, mix, range_hash, slabs, space_joined, spread, sums, word_hashes, words
from blackspot.llm.common import id_key
from blackspot.runtime import cut, forget

PLACE_BITS = 10  # of a run's number of windows, and of its anchor's place
#: A key with more different texts than this is split.
CROWD = 1000
#: Bits of the anchor's place that a round of splitting looks at: two make four parts of a run.
SPLIT_BITS = 2
#: Bytes of buckets that a task compares at once.
BLOCK = 1 << 21

PIECE = "key long, one long, two long, doc long, run long, crowd boolean, text binary"


class Unit(NamedTuple):
    """What a symbol is. ``read`` gives symbol values, the first symbol of every text, and the text with the places of its symbols."""
    powers: Powers
    read: Callable
    gap: int


def read_bytes(data: np.ndarray, offsets: np.ndarray):
    return data.astype(np.uint64) + np.uint64(1), offsets, data, np.arange(len(data) + 1)


def read_words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = words(data, offsets)
    return word_hashes(data, starts, ends), first, *space_joined(data, starts, ends)


BYTE_UNIT, WORD_UNIT = Unit(BYTES, read_bytes, 0), Unit(WORDS, read_words, 1)


def numbered(docs: DataFrame) -> DataFrame:
    """``(doc, doc_id, text)``, where ``doc`` orders documents like doc_id and names one text.

    Usually ``doc`` is the doc_id. If a doc_id occurs twice, the different pairs
    of doc_id and text are numbered in their order instead; rows that repeat both
    are one document.
    """
    rows = docs.select(id_key().alias("doc"), id_key().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.groupBy("doc").count().filter("count > 1").isEmpty():
        return rows
    pairs = rows.select("doc_id", F.sha2("text", 256).alias("_sha")).distinct()
    order = cut(pairs.repartitionByRange("doc_id", "_sha").sortWithinPartitions("doc_id", "_sha")
                .withColumn("doc", F.monotonically_increasing_id()))
    return (rows.drop("doc").withColumn("_sha", F.sha2("text", 256)).join(order, ["doc_id", "_sha"])
            .select("doc", "doc_id", "text"))


def copies(rows: DataFrame) -> DataFrame:
    """``(doc, head, n)`` for every document whose whole text occurs in ``n > 1`` rows; ``head`` is the first of them."""
    texts = rows.select("doc", F.sha2("text", 256).alias("sha"))
    groups = cut(texts.groupBy("sha").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return cut(split_join(texts, groups, ["sha"], "n", "doc").select("doc", "head", "n").distinct())


def claim(unit: Unit, window: int, gram: int):
    """Anchors and their runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offsets in each_slab(b):
                values, first, *_ = unit.read(data, offsets)
                seq, start, count, key, place = anchors(values, first, window, gram, unit.powers)
                yield record("key doc run", key.view(np.int64), part["doc"].to_numpy()[seq], pack(start - first[seq], count, place - start))
    return run


def repeated_runs(rows: DataFrame, twins: DataFrame, unit: Unit, window: int, gram: int) -> DataFrame:
    """``(doc, runs)``: the runs of windows of each document whose anchor occurs twice, as ``(key, run, crowd)``.

    Anchors are counted over the whole corpus. Copies of whole texts but the first
    are left out.
    """
    found = rows.select("doc", "text").mapInArrow(claim(unit, window, gram), "key long, doc long, run long")
    many = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("places")).filter("places > 1"))
    near = split_join(found, many, ["key"], "places", "doc")
    later = twins.filter("doc <> head").select("doc")
    return near.join(later, "doc", "left_anti").groupBy("doc").agg(
        F.collect_list(F.struct("key", "run", (F.col("places") > CROWD).alias("crowd"))).alias("runs"))


def flat_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, runs and crowd flags of a column of ``repeated_runs``, and the row of each."""
    listed, row = list_rows(column)
    key, run, crowd = (listed.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    return key.astype(np.int64), run.astype(np.int64), crowd.astype(bool), row


def first_of_equal(one: np.ndarray, two: np.ndarray, doc: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are the first of those that equal them, and which of these have others."""
    order = np.lexsort((run, doc, two, one))
    lead, more = np.zeros(len(order), bool), np.zeros(len(order), bool)
    if len(order):
        head = np.flatnonzero(np.append(True, (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])))
        lead[order[head]] = True
        more[order[head]] = np.diff(np.append(head, len(order))) > 1
    return lead, more


def rows_of(key, one, two, doc, run, crowd, raw: np.ndarray, start: np.ndarray, stop: np.ndarray, all_copies: bool) -> pa.RecordBatch:
    """Rows of ``PIECE``: the first of equal texts with its text, the others without, which says that they are repeated.

    With ``all_copies`` the first of several is repeated too and gets a second row.
    """
    lead, more = first_of_equal(one, two, doc, run)
    again = np.flatnonzero(more) if all_copies else np.zeros(0, np.int64)
    text = raw.tobytes()
    texts = [text[i:j] if k else None for i, j, k in zip(start.tolist(), stop.tolist(), lead.tolist())] + [None] * len(again)
    own = np.append(np.arange(len(lead)), again)
    return record("key one two doc run crowd text", key[own], one.view(np.int64)[own], two.view(np.int64)[own], doc[own], run[own], crowd[own],
                  pa.array(texts, pa.binary()))


def pieces(unit: Unit, window: int, all_copies: bool):
    """The texts of the runs listed for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offsets in each_slab(b):
                values, first, raw, at = unit.read(data, offsets)
                key, packed, crowd, row = flat_runs(part["runs"])
                place, count, _ = unpack(packed)
                start = first[row] + place
                stop = start + count + window - 1
                one, two = (mix(range_hash(sums(values, p), start, stop, p)) for p in (unit.powers, SECOND))
                yield rows_of(key, one, two, part["doc"].to_numpy()[row], packed, crowd, raw, at[start], at[stop] - unit.gap, all_copies)
    return run


def split(unit: Unit, window: int, gram: int, bits: int, all_copies: bool):
    """Parts of runs in which the place of the anchor agrees but for its last ``bits``, keyed by all that such windows share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offsets in each_slab(b):
                values, first, raw, at = unit.read(data, offsets)
                doc, packed = part["doc"].to_numpy(), part["run"].to_numpy()
                place, count, anchor = unpack(packed)
                least = anchor - count + 1
                owner, rank = spread((anchor >> bits) - (least >> bits) + 1)
                node = (least >> bits)[owner] + rank
                low, high = np.maximum(least[owner], node << bits), np.minimum(anchor[owner], (node + 1 << bits) - 1)
                middle = first[owner] + anchor[owner]
                start = middle - high
                stop = middle - low + window
                one, two = sums(values, unit.powers), sums(values, SECOND)
                shared = range_hash(one, middle - (node << bits), middle + window - np.minimum((node + 1 << bits) - 1, window - gram), unit.powers)
                key = mix(shared + mix((node << 8 | bits + 1).astype(np.uint64))).view(np.int64)
                yield rows_of(key, mix(range_hash(one, start, stop, unit.powers)), mix(range_hash(two, start, stop, SECOND)), doc[owner],
                              pack(place[owner] + anchor[owner] - high, high - low + 1, high), np.ones(len(key), bool), raw, at[start],
                              at[stop] - unit.gap, all_copies)
    return run


def settled(pieces_: DataFrame, window: int) -> DataFrame:
    """``(doc, s, e)`` of runs that are known to be repeated."""
    mask = (1 << PLACE_BITS) - 1
    start = F.shiftright("run", 2 * PLACE_BITS)
    return pieces_.select("doc", start.alias("s"), (start + F.shiftright("run", PLACE_BITS).bitwiseAND(F.lit(mask)) + (window - 1)).alias("e"))


def thinned(crowded: DataFrame, unit: Unit, window: int, gram: int, all_copies: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Texts by finer keys, none of which is crowded, and spans that were settled on the way."""
    texts, spans, bits = [], [], (window - gram).bit_length()
    state = crowded
    while not state.isEmpty():
        bits = max(bits - SPLIT_BITS, 0)
        parts = cut(state.mapInArrow(split(unit, window, gram, bits, all_copies), PIECE))
        forget(state)
        spans.append(settled(parts.filter("text is null"), window))
        parts = parts.filter("text is not null").drop("crowd")
        equal = parts.groupBy("key", "one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "run")).alias("lead"))
        keys = equal.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("places")).filter("places > 1")
        equal = split_join(equal, keys, ["key"], "texts", "one")
        judged = cut(split_join(parts, equal, ["key", "one", "two"], "n", "doc").withColumn("lead", F.struct("doc", "run") == F.col("lead"))
                     .withColumn("text", F.when(F.col("lead"), F.col("text"))))
        spans.append(settled(judged.filter("n > 1" if all_copies else "not lead"), window))
        texts.append(judged.filter(f"lead and texts between 2 and {CROWD}").select("key", "doc", "run", "text"))
        state = judged.filter(f"lead and texts > {CROWD}").select("doc", "run", "text")
    return texts, spans


def repeated_spans(rows: DataFrame, twins: DataFrame, unit: Unit, window: int, gram: int, all_copies: bool, compare) -> DataFrame:
    """``(doc, s, e)``: spans of repeated windows, but for copies of whole texts other than the first.

    ``compare`` gets whole buckets as ``key, doc, run, text`` and gives spans. With
    ``all_copies`` every one of equal windows counts, else all but the first.
    """
    listed = repeated_runs(rows, twins, unit, window, gram)
    found = cut(rows.join(listed, "doc").select("doc", "text", "runs").mapInArrow(pieces(unit, window, all_copies), PIECE))
    texts, spans = thinned(found.filter("crowd and text is not null").select("doc", "run", "text"), unit, window, gram, all_copies)
    spans.append(settled(found.filter("text is null"), window))
    open_ = found.filter("text is not null and not crowd").select("key", "doc", "run", "text")
    for more in texts:
        open_ = open_.unionAll(more)
    out = open_.repartition("key").sortWithinPartitions("key").mapInArrow(by_bucket(compare), "doc long, s long, e long")
    for more in spans:
        out = out.unionAll(more)
    return out


def by_bucket(compare):
    """Whole buckets, as many at a time as ``BLOCK`` takes; the rows of a task come in the order of their keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, held = [], 0
        for b in batches:
            if not len(b):
                continue
            left.append(b)
            held += b["text"].nbytes + 64 * len(b)
            if held >= BLOCK:
                t = pa.Table.from_batches(left).combine_chunks().to_batches()[0]
                key = t["key"].to_numpy()
                end = int(np.searchsorted(key, key[-1], "left"))  # the last bucket may go on
                if end:
                    yield from in_blocks(t.slice(0, end), compare)
                left = [t.slice(end)]
                held = sum(x["text"].nbytes + 64 * len(x) for x in left)
        if left:
            yield from in_blocks(pa.Table.from_batches(left).combine_chunks().to_batches()[0], compare)
    return run


def in_blocks(t: pa.RecordBatch, compare) -> Iterator[pa.RecordBatch]:
    key = t["key"].to_numpy()
    total = np.append(0, np.cumsum(pc.binary_length(t["text"]).to_numpy().astype(np.int64) + 64))
    row = 0
    while row < len(t):
        end = int(np.searchsorted(total, total[row] + BLOCK, "right")) - 1
        end = min(max(end, row + 1), len(t))
        if end < len(t):
            cut_at = int(np.searchsorted(key, key[end], "left"))
            end = cut_at if cut_at > row else int(np.searchsorted(key, key[row], "right"))
        yield compare(t.slice(row, end - row))
        row = end


def bytes_of(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts of a block and where each starts."""
    text = t["text"].cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(t) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pack(start: np.ndarray, count: np.ndarray, place: np.ndarray | int = 0) -> np.ndarray:
    return (start.astype(np.int64) << 2 * PLACE_BITS) | (count.astype(np.int64) << PLACE_BITS) | place


def unpack(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << PLACE_BITS) - 1
    return run >> 2 * PLACE_BITS, run >> PLACE_BITS & mask, run & mask


def record(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def list_rows(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a list column and the row of each."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of maximal runs of set flags within one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.append(True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]))
    head = np.flatnonzero(new)
    return at[head], at[np.append(head[1:], len(at)) - 1]


def with_spans(rows: DataFrame, spans: DataFrame, twins: DataFrame) -> DataFrame:
    """``rows`` with the list of spans of their document and its row of ``copies``, if any."""
    per_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return rows.join(per_doc, "doc", "left").join(twins, "doc", "left")


def each_slab(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for row, data, offsets in slabs(b["text"]):
        yield b.slice(row, len(offsets) - 1), data, offsets


def span_cover(part: pa.RecordBatch, first: np.ndarray, total: int, window: int, all_of_copies) -> np.ndarray:
    """Which symbols of a slab are removed: those in spans, and all of a copy of at least a window."""
    at, row = list_rows(part["spans"])
    s, e = (at.field(i).to_numpy(zero_copy_only=False).astype(np.int64) + first[row] for i in (0, 1)) if len(at) else (np.zeros(0, int),) * 2
    size = np.diff(first)
    whole = np.flatnonzero(all_of_copies(part) & (size >= window))
    return covered(total, np.append(s, first[whole]), np.append(e, first[whole + 1]))
