"""SimHash near duplicates by covering locality-sensitive hashing.

Fingerprints within ``max_distance`` bits are linked. Every bit gets a nonzero
code of ``max_distance + 1`` bits, and there is one mask for every nonzero
vector of that length: it keeps the bits whose code has odd parity with the
vector. The codes of at most ``max_distance`` differing bits cannot span the
whole space, so some vector is orthogonal to all of them, and under its mask the
two fingerprints are equal. Every linked pair therefore meets in some table.

Fingerprints that meet are not paired. Each lists the points within half the
distance of it, among the bits its mask leaves open; two fingerprints are within
the distance exactly if they share such a point. The fingerprints around a point
are few and are linked to one of them, so a bucket of any size costs a fixed
number of rows for each member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blackspot.clustering.components import components
from blackspot.joins import split_join
from blackspot.llm.arrays import slabs, space_joined, spread, words
from blackspot.llm.common import documents, id_back, id_key, stored
from blackspot.runtime import cut

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
BITS = 64
FULL = (1 << BITS) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def masks(max_distance: int = MAX_DISTANCE) -> list[list[int]]:
    """The bits left open by each mask of the covering family."""
    size = 1 << (max_distance + 1)
    code = [bit % (size - 1) + 1 for bit in range(BITS)]
    return [[bit for bit in range(BITS) if (code[bit] & vector).bit_count() % 2 == 0] for vector in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    n_docs = len(offsets) - 1
    out = np.zeros(n_docs, np.uint64)
    if not len(starts):
        return out
    # Words joined by one space each, so that a shingle is a range of bytes.
    buffer, at = space_joined(data, starts, ends)
    counts = np.diff(first)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc, rank = spread(shingles)
    begin = first[doc] + rank
    stop = np.minimum(begin + width, first[doc + 1]) - 1
    text, digest = buffer.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[stop + 1] - 1).tolist())),
                    np.uint64, len(begin))
    some = np.flatnonzero(shingles)
    heads = (np.cumsum(shingles) - shingles)[some]
    for low in range(0, BITS, 8):
        byte = ((h >> np.uint64(low)) & np.uint64(255)).astype(np.uint8)
        ones = np.add.reduceat(np.unpackbits(byte[:, None], axis=1, bitorder="little"), heads, axis=0, dtype=np.int64)
        out[some] |= (np.packbits(2 * ones > shingles[some, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(low))
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, hashed: bool = False) -> DataFrame:
    """``(doc, fp)`` for every row of ``docs``; ``fp`` is the fingerprint as a signed long.

    With ``hashed`` also ``h``, the hash of the text, which tells rows with one doc_id apart.
    """
    more = [F.xxhash64("text").alias("h")] if hashed else []
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_fingerprints(data, offsets, width) for _, data, offsets in slabs(b["text"])]
            own = [b["doc"], *([b["h"]] if hashed else [])]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate([np.zeros(0, np.uint64), *fp]).view(np.int64))],
                                             names=["doc", *(["h"] if hashed else []), "fp"])
    return docs.select(id_key().alias("doc"), *more, "text").mapInArrow(scan, "doc long, h long, fp long" if hashed else "doc long, fp long")


def points(mask_open: list[int], reach: int) -> list[int]:
    """What to flip in a fingerprint to get every point within ``reach`` among the open bits."""
    return [signed(sum(1 << b for b in bits)) for k in range(reach + 1) for bits in combinations(mask_open, k)]


def near_links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints ``fp`` within ``max_distance`` bits.

    ``fps`` holds every fingerprint once. Two fingerprints within the distance are
    linked directly or through others that are linked.
    """
    families = masks(max_distance)
    keep = [signed(~sum(1 << b for b in bits) & FULL) for bits in families]
    tables = F.posexplode(F.array(*[F.lit(m).bitwiseAND(F.col("fp")) for m in keep])).alias("mask", "key")
    placed = fps.select("fp", tables)
    crowded = cut(placed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    met = split_join(placed, crowded, ["mask", "key"], "members", "fp")
    near, far = max_distance // 2, (max_distance + 1) // 2
    choice = F.lit(None)
    for i, bits in enumerate(families):
        choice = F.when(F.col("mask") == i, F.array(*[F.struct(F.lit(x).bitwiseXOR(F.col("fp")).alias("point"),
                                                                F.lit((x & FULL).bit_count() <= near).alias("near"))
                                                      for x in points(bits, far)])).otherwise(choice)
    around = met.select("fp", F.explode(choice).alias("p")).select("fp", "p.point", "p.near").distinct()
    # A point has few fingerprints around it: one and those that differ from it in ``far`` bits or fewer.
    groups = around.groupBy("point").agg(F.collect_set("fp").alias("fps"), F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"))
    return (groups.filter("hub is not null and size(fps) > 1").select(F.explode("fps").alias("a"), F.col("hub").alias("b"))
            .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).distinct())


def named_groups(prints: DataFrame, row: Column, max_distance: int) -> DataFrame:
    """``(fp, n, component)`` for every fingerprint: its rows, and the least ``row`` of its group."""
    classes = prints.groupBy("fp").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes)
    roots = components(near_links(classes.select("fp"), max_distance))
    rooted = cut(classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
                 .select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    return cut(split_join(rooted, cut(groups), ["root"], "members", "fp").select("fp", "n", "component"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Every row of ``docs`` with its fingerprint and its group of near duplicates.

    Returns ``doc_id, fingerprint, component_id``; the group is named by its
    smallest doc_id. A text with fewer words than a shingle is one shingle; a
    null, empty or blank text has fingerprint zero, which links like any other.
    A null doc_id is smaller than all others. Repeated rows come out as often as
    they come in; an empty table gives no rows; other columns are not read.
    """
    prints = stored(fingerprints(docs, width))
    named = named_groups(prints, F.col("doc"), max_distance)
    out = split_join(prints, named, ["fp"], "n", "doc")
    return out.select(id_back(F.col("doc")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      id_back(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each group of near duplicates, with all its columns.

    It is a row with the smallest doc_id of the group. If several have it, texts
    are told apart by their hash and the least hash stays; of rows that repeat
    both, the one with the least other columns.
    """
    prints = stored(fingerprints(docs, width, hashed=True))
    named = named_groups(prints, F.struct("doc", "h"), max_distance)
    heads = F.struct("doc", "h") == F.col("component")
    rows = split_join(prints, named, ["fp"], "n", ["doc", "h"]).select("doc", "h", heads.alias("head"))
    marks = rows.groupBy("doc", "h").agg(F.min("head").alias("_head"), F.count(F.lit(1)).alias("_rows"))
    marks = cut(marks.filter(~F.col("_head") | (F.col("_rows") > 1)).withColumnsRenamed({"doc": "_gone", "h": "_h"}))
    match = (id_key() == F.col("_gone")) & (F.xxhash64("text") == F.col("_h"))
    single = docs.join(marks, match, "left_anti")
    repeated = marks.filter("_head").select("_gone", "_h")
    if repeated.isEmpty():
        return single
    # Equal rows are reduced by partial aggregates, so a crowd of them does not meet in one task.
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    firsts = (docs.join(repeated, match, "left_semi").groupBy(id_key().alias("_gone"), F.xxhash64("text").alias("_h"))
              .agg(F.min(row).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
    return single.unionAll(firsts)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
