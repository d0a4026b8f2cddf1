"""Exact duplicates by an extendible-hash index on shared files.

The index maps a 64-bit key of a text to the chain of different texts with that
key. Its directory is indexed by the leading bits of the key; a bucket with more
keys than its capacity is split by one more bit, which doubles the directory
where it is deepest. Every bucket has one owner task, which meets the texts of
its range of keys, follows the chains and compares bytes. The finished entries
are a Parquet table in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from blackspot.joins import split_join
from blackspot.llm.common import documents, id_back, id_key, stored
from blackspot.runtime import cut

CAPACITY = 4096
#: The directory is counted this many bits deeper than evenly spread keys need.
SPARE_BITS = 4

INDEX = "bucket long, key long, chain int, sha string, keep long, n long"


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``(slot, bucket, depth)`` for every slot of the directory, and its number of bits.

    ``keys`` has one row per different key. Keys are counted once by their
    leading bits; a bucket is the shortest prefix that holds no more than
    ``capacity`` keys, so the counts are folded prefix by prefix and no text is
    read again when a bucket splits.
    """
    total = keys.count()
    bits = max(1, int(max(total, 1) / capacity).bit_length() + SPARE_BITS)
    slot = F.shiftrightunsigned("key", 64 - bits).alias("slot")
    slots = cut(keys.groupBy(slot).agg(F.count(F.lit(1)).alias("load")))
    split = slots.withColumns({"depth": F.lit(bits), "bucket": F.col("slot") + F.lit(1 << bits)})
    for depth in range(bits - 1, -1, -1):
        prefix = F.shiftright("slot", bits - depth)
        loads = slots.groupBy(prefix.alias("_prefix")).agg(F.sum("load").alias("_sum")).filter(F.col("_sum") <= capacity)
        fits = F.col("_sum").isNotNull()
        split = (split.join(loads, F.shiftright("slot", bits - depth) == F.col("_prefix"), "left")
                 .withColumns({"depth": F.when(fits, F.lit(depth)).otherwise(F.col("depth")),
                               # A leading one keeps prefixes of different lengths apart.
                               "bucket": F.when(fits, F.col("_prefix") + F.lit(1 << depth)).otherwise(F.col("bucket"))})
                 .drop("_prefix", "_sum"))
    return cut(split.select("slot", "bucket", "depth")), bits


def chains(key: np.ndarray, text: pa.Array) -> np.ndarray:
    """For rows sorted by key: the row that first holds the same bytes under the same key."""
    first = np.arange(len(key))
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    at, chain = -1, {}
    for i in same.tolist():
        if i - 1 != at:  # a new key: its chain starts with the row before
            chain = {text[i - 1].as_py(): i - 1}
        at = i
        first[i] = chain.setdefault(text[i].as_py(), i)
    return first


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch become one entry, so a crowd of copies travels once per batch."""
    for b in batches:
        b = b.take(pa.array(np.argsort(b["key"].to_numpy(), kind="stable")))
        text = b["text"].cast(pa.large_binary())
        first = chains(b["key"].to_numpy(), text)
        rows, member, n = np.unique(first, return_inverse=True, return_counts=True)
        keep = np.full(len(rows), np.iinfo(np.int64).min)
        np.maximum.at(keep, member, b["doc"].to_numpy())
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([b["slot"].take(take), b["key"].take(take), text.take(take).cast(pa.binary()),
                                          pa.array(keep), pa.array(n)], names=["slot", "key", "text", "keep", "n"])


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One owner task: its entries arrive in the order of their keys."""
    left: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([left, t]) if left is not None else t
        key = t["key"].to_numpy()
        end = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # the last key may go on
        if end:
            yield finish(t.slice(0, end))
        left = t.slice(end)
    if left is not None and len(left):
        yield finish(left)


def finish(t: pa.Table) -> pa.RecordBatch:
    t = t.combine_chunks()
    key, text = t["key"].to_numpy(), t["text"].combine_chunks().cast(pa.large_binary())
    first = chains(key, text)
    rows, member = np.unique(first, return_inverse=True)
    keep, n = np.full(len(rows), np.iinfo(np.int64).min), np.zeros(len(rows), np.int64)
    np.maximum.at(keep, member, t["keep"].to_numpy())
    np.add.at(n, member, t["n"].to_numpy())
    heads = key[rows]
    chain = np.arange(len(rows)) - np.searchsorted(heads, heads, "left")
    sha = [hashlib.sha256(text[i].as_buffer()).hexdigest() for i in rows.tolist()]
    return pa.RecordBatch.from_arrays([t["bucket"].combine_chunks().take(pa.array(rows)), pa.array(heads), pa.array(chain, pa.int32()),
                                       pa.array(sha), pa.array(keep), pa.array(n)], names=["bucket", "key", "chain", "sha", "keep", "n"])


def text_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(id_key().alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index of all texts as a table on shared files: ``bucket, key, chain, sha, keep, n``.

    ``chain`` numbers the different texts of one key, ``keep`` is the largest
    doc_id of the equal texts and ``n`` their number.
    """
    rows = text_keys(docs)
    slots, bits = directory(rows.select("key").distinct(), capacity)
    # In the order of keys: a task owns whole buckets, as a bucket is a range of keys.
    slot = F.shiftrightunsigned("key", 64 - bits)
    entries = rows.select(slot.alias("slot"), "key", F.col("text").cast("binary").alias("text"), "doc").mapInArrow(
        gather, "slot long, key long, text binary, keep long, n long")
    owned = (entries.join(slots.select("slot", "bucket"), "slot").repartition("bucket")
             .sortWithinPartitions("key").select("bucket", "key", "text", "keep", "n"))
    return stored(owned.mapInArrow(own, INDEX))


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every row of ``docs`` with the row that stays of the rows with equal text.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``. A null text counts
    as empty. The largest doc_id stays; a null doc_id is smaller than all others.
    Rows that repeat a doc_id and its text are counted each and stay or go
    together. An empty table gives no rows; other columns are not read.
    """
    index = build_index(docs, capacity)
    rows = text_keys(docs).select("doc", "key", F.sha2("text", 256).alias("sha"))
    out = split_join(rows, index.select("key", "sha", "keep", "n"), ["key", "sha"], "n", "doc")
    return out.select(id_back(F.col("doc")).alias("doc_id"), id_back(F.col("keep")).alias("keep_id"),
                      F.col("n").alias("group_size"), (F.col("doc") == F.col("keep")).alias("kept"),
                      F.col("sha").alias("text_sha256"))


def keep_unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = exact_duplicates(docs).filter(~F.col("kept")).select(id_key().alias("_gone"), F.col("text_sha256").alias("_sha"))
    match = (id_key() == F.col("_gone")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("_sha"))
    return docs.join(gone.distinct(), match, "left_anti")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP9_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
