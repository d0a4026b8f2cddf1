"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short, documents long, so the sets of shingles as wholes are hardly
alike even when a document holds an item. Items are therefore partitioned by
size, and for each size documents are searched in windows of up to twice that
size which overlap by half, so a whole item always lies in some window of its
scale and is a fair share of it. Item and window have a one-permutation MinHash
sketch: the least hash in each of ``BINS`` bins. A window and an item are
candidates if they agree in a bin. What both share is the least of its bin on both
sides for many bins at once, so a true match is practically never missed, and
agreement by chance does not happen with 64-bit hashes.

A window of an item of at most ``SMALL`` shingles has no more shingles than bins,
so it is not thinned out: the item's sketch is as many of its shingles, the rarest
of the block and then the least hashes first, as must hold one that a match shares.
Such items are found for certain. An item with fewer words than a shingle is one
shingle of its own length.

A candidate document is then verified with the exact containment: the share of
the item's different shingles that occur anywhere in the document.

Items are the query set. Their different texts are numbered into blocks bounded in
rows and bytes; documents are searched in one scan for each block, whose sketches
are sent to the tasks, and the matches are written before the next block is read.
Documents are not shuffled. Items with one text are searched once and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from blackspot.joins import split_join
from blackspot.llm.arrays import ALNUM, WORDS, mix, range_hash, spread, sums, word_hashes, words
from blackspot.llm.common import documents, id_back, id_key, in_parts, stored, text_batches
from blackspot.llm.repeats import each_slab, record
from blackspot.llm.simhash import LOWER
from blackspot.runtime import cut, scratch_path

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BINS = 64
#: Most shingles of an item whose window has a bin for every shingle.
SMALL = BINS // 2
#: Most item texts in a block, which is collected and sent to the tasks, and most bytes of them but for the last text.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
#: Item ids, on average, in a list that is joined to the matches of their text.
LIST = 1000

FOUND = "doc long, h long, no long, shared long, size long"
MATCH = "doc long, h long, item long, shared long, size long"


def word_sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running hashes of the words of all texts, and the first word of each text (one more at the end)."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets, ALNUM)
    return sums(word_hashes(data, starts, ends), WORDS), first


def shingles(total: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text, and the first of each text (one more at the end)."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    owner, rank = spread(counts)
    at = first[owner] + rank
    return mix(range_hash(total, at, at + width, WORDS)), np.append(0, np.cumsum(counts))


def scale(size: np.ndarray) -> np.ndarray:
    """The size class of sets of so many shingles: the least power of two that holds them, as an exponent."""
    return np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)


def sketch(hashes: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """One-permutation MinHash: the least hash of each group in each bin (all ones in an empty bin)."""
    out = np.full(groups * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, group * BINS + (hashes % np.uint64(BINS)).astype(np.int64), hashes)
    return out.reshape(groups, BINS)


class Lookup:
    """Items by hashes that stand for them."""

    def __init__(self, value: np.ndarray, item: np.ndarray):
        order = np.argsort(value)
        self.value, self.item = value[order], item[order]

    def hits(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in ``wanted`` and an item with that hash."""
        at = np.searchsorted(self.value, wanted)
        hit = np.flatnonzero((at < len(self.value)) & (self.value[np.minimum(at, len(self.value) - 1)] == wanted))
        at = at[hit]
        who, rank = spread(np.searchsorted(self.value, wanted[hit], "right") - at)
        return hit[who], self.item[at[who] + rank]


def rarest(flat: np.ndarray, group: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Places of the ``keep`` values of each group that are rarest in ``flat``, the least among equals."""
    _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((flat, often[at], group))
    sizes = np.bincount(group, minlength=len(keep))
    return order[spread(sizes)[1] < keep[group[order]]]


class Queries:
    """The sketches of a block of items, by size class, for look-up by hash."""

    def __init__(self, ids: list[int], texts: list[bytes], width: int, threshold: float, short: bool):
        joined = pa.array(texts, pa.large_binary())
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[:sum(map(len, texts))]
        total, first = word_sums(data, np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64))
        n_words = np.diff(first)
        self.ids, self.width, self.threshold = np.array(ids, np.int64), width, threshold
        hashes, at = shingles(total, first, width)
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.by_width = {}
        for w in np.unique(n_words[(n_words > 0) & (n_words < width)]).tolist() if short else []:
            own = np.flatnonzero(n_words == w)
            self.by_width[w] = Lookup(mix(range_hash(total, first[own], first[own] + w, WORDS)), own)
            self.size[own] = 1
        whole = n_words >= width
        self.small = None
        own = np.flatnonzero(whole & (self.size <= SMALL))
        if len(own):
            flat, group = self.flat(own)
            size = self.size[own]
            kept = rarest(flat, group, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)
            self.small = Lookup(flat[kept], own[group[kept]])
        classes = np.where(whole & (self.size > SMALL), scale(self.size), -1)
        self.by_scale = {}
        for c in np.unique(classes[classes >= 0]).tolist():
            own = np.flatnonzero(classes == c)
            table = sketch(*self.flat(own), len(own))
            full = table != np.iinfo(np.uint64).max
            self.by_scale[c] = Lookup(table[full], own[np.nonzero(full)[0]])

    def flat(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of some items, and the rank of the item of each."""
        return np.concatenate([self.sets[i] for i in own]), np.repeat(np.arange(len(own)), self.size[own])

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Pairs (document, item) that agree in a hash of their sketches, packed and sorted."""
        found = [np.zeros(0, np.int64)]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if self.small:
            at, item = self.small.hits(hashes)
            found.append((doc[at] << 32) | item)
        for c, known in self.by_scale.items():
            # Half windows of 2**c shingles within each document; two neighbours make a window.
            half = (np.arange(len(hashes)) - first[doc]) >> c
            per = (np.diff(first) + (1 << c) - 1) >> c
            base = np.cumsum(per) - per
            table = sketch(hashes, base[doc] + half, int(per.sum()))
            owner = np.repeat(np.arange(len(per)), per)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            table[same] = np.minimum(table[same], table[same + 1])
            at, item = known.hits(table.ravel())
            found.append((owner[at // BINS] << 32) | item)
        return np.unique(np.concatenate(found))

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """``(text, item, shared shingles)`` of the verified pairs of a slab."""
        total, words_of = word_sums(data, offsets)
        out, last, own = [], -1, None
        for w, known in self.by_width.items():
            hashes, first = shingles(total, words_of, w)
            at, item = known.hits(hashes)
            pairs = np.unique((np.searchsorted(first, at, "right") - 1 << 32) | item)
            out += [(pair >> 32, pair & 0xFFFFFFFF, 1) for pair in pairs.tolist()]
        hashes, first = shingles(total, words_of, self.width)
        for pair in self.candidates(hashes, first).tolist():
            doc, item = pair >> 32, pair & 0xFFFFFFFF
            if doc != last:
                last, own = doc, np.unique(hashes[first[doc]:first[doc + 1]])
            want = self.sets[item]
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            shared = int((own[at] == want).sum())
            if shared >= self.threshold * len(want) - 1e-9:
                out.append((doc, item, shared))
        return out


def item_texts(items: DataFrame, item_id: str) -> tuple[DataFrame, DataFrame]:
    """The different ``(item, text)``, and their different texts as ``(bucket, rows, bytes, no, text, n)``.

    ``n`` items have the text number ``no``; the first three columns name its block.
    Texts are dealt to buckets by hash, which is even since each occurs once, and
    cut within a bucket wherever a block is full, however they were dealt.
    """
    pairs = items.select(F.col(item_id).cast("long").alias("item"), "text").dropna().distinct()
    texts = cut(pairs.groupBy("text").agg(F.count(F.lit(1)).alias("n")))
    buckets = max(1, -(-texts.count() // (ITEMS // 2)))
    bucket = Window.partitionBy("bucket").orderBy("text")
    before = F.coalesce(F.sum(F.octet_length("text").cast("long")).over(bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts = (texts.withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(buckets)))
             .withColumns({"row": F.row_number().over(bucket).cast("long") - 1, "before": before})
             .select("bucket", F.floor(F.col("row") / ITEMS).alias("rows"), F.floor(F.col("before") / ITEM_BYTES).alias("bytes"),
                     (F.shiftleft("bucket", 32) + F.col("row")).alias("no"), "text", "n"))
    return pairs, cut(texts)


def matched_texts(docs: DataFrame, texts: DataFrame, width: int, threshold: float, short: bool) -> DataFrame:
    """``(doc, h, no, shared, size)`` of all documents and item texts, block after block, as a table."""
    spark = docs.sparkSession
    rows = docs.select(id_key().alias("doc"), F.xxhash64("text").alias("h"), "text")
    path = scratch_path(spark, "matches")
    spark.createDataFrame([], FOUND).write.parquet(path)
    name = ["bucket", "rows", "bytes"]
    for block in texts.select(name).distinct().orderBy(name).collect():
        own = texts.filter(" and ".join(f"{c} = {block[c]}" for c in name)).select("no", "text").collect()
        queries = Queries([r["no"] for r in own], [r["text"].encode() for r in own], width, threshold, short)

        def run(batches: Iterator[pa.RecordBatch], queries: Queries = queries) -> Iterator[pa.RecordBatch]:
            for b in in_parts(batches):
                for part, data, offsets in each_slab(b):
                    at, item, shared = np.array(queries.matches(data, offsets), np.int64).reshape(-1, 3).T
                    yield record("doc h no shared size", part["doc"].to_numpy()[at], part["h"].to_numpy()[at],
                                 queries.ids[item], shared, queries.size[item])
        with text_batches(spark):
            rows.mapInArrow(run, FOUND).write.mode("append").parquet(path)
    return spark.read.schema(FOUND).parquet(path)


def contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id", width: int = SHINGLE_WORDS,
                 threshold: float = THRESHOLD) -> DataFrame:
    """``(doc, h, item, shared, size)`` for every document that holds ``threshold`` of an item's shingles.

    Words are runs of ASCII letters and digits and of other characters beyond
    ASCII, with A-Z in lower case. An item with fewer words than a shingle is one
    shingle, all its words; null texts and those without a word match nothing.
    Rows of ``items`` without an id are left out, equal rows count once, and two
    texts under one id are two items. Every row of ``docs`` comes out for each of
    its items, repeated rows too; an empty table on either side gives no rows.
    ``h`` is the hash of the document's text, which tells rows with one doc_id
    apart. Other columns are not read.
    """
    pairs, texts = item_texts(items, item_id)
    found = matched_texts(docs, texts, width, threshold, True)
    lists = F.ceil(F.col("n") / LIST).alias("lists")
    classes = cut(found.groupBy("no").agg(F.count(F.lit(1)).alias("_rows")).join(texts.select("no", "n", lists), "no"))
    named = split_join(pairs, texts.select("text", "no", "n", lists), ["text"], "n", "item")
    listed = (named.groupBy("no", F.pmod(F.xxhash64("item"), F.col("lists")).alias("list")).agg(F.collect_list("item").alias("items"))
              .join(classes.select("no", "_rows"), "no"))
    each = (split_join(found, classes, ["no"], "_rows", ["doc", "h"]).drop("_rows")
            .withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists") - 1))))
    return (split_join(each, cut(listed), ["no", "list"], "_rows", ["doc", "h"])
            .select("doc", "h", F.explode("items").alias("item"), "shared", "size"))


def drop_contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id", width: int = SHINGLE_WORDS,
                      threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Items with fewer words than a shingle drop nothing: a word or two stand in
    clean documents as well. Null and empty texts hold nothing and stay, as do
    all rows if there are no items; repeated rows stay or go together.
    """
    found = matched_texts(docs, item_texts(items, item_id)[1], width, threshold, False)
    gone = stored(found.select(F.col("doc").alias("_gone"), F.col("h").alias("_h")).distinct())
    return docs.join(gone, (id_key() == F.col("_gone")) & (F.xxhash64("text") == F.col("_h")), "left_anti")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, with the exact containment."""
    found = contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return stored(found.select(id_back(F.col("doc")).alias("doc_id"), F.col("item").alias("item_id"), F.col("shared").alias("n_shared"),
                               F.col("size").alias("n_shingles"), (F.col("shared") / F.col("size")).alias("containment")))


def _words_sql(table: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM {table}"


OP2_SQL = f"""WITH iw AS (SELECT *, least(len(ws), {SHINGLE_WORDS}) AS w FROM ({_words_sql("benchmark", "item_id")}) WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, w, array_to_string(ws[i:i + w - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS i FROM iw)),
dw AS (SELECT * FROM ({_words_sql("documents", "doc_id")}) JOIN (SELECT DISTINCT w FROM q) ON len(ws) >= w),
d AS (SELECT DISTINCT doc_id, w, array_to_string(ws[i:i + w - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS i FROM dw)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id),
pairs AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN q USING (w, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / CAST(n_shingles AS DOUBLE) AS containment
FROM pairs JOIN sizes USING (item_id) WHERE n_shared >= {THRESHOLD} * n_shingles - 1e-9"""
