"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

The corpus is its own reference. It is cut into blocks: maximal runs of word
windows that share a content-chosen anchor, so that a repeated passage is cut in
much the same way wherever it stands. Blocks are indexed by their anchor and every
block is parsed greedily against all earlier blocks with its anchor: a factor
starts where a window of it stands in an earlier block and goes on as far as the
words of both agree; windows across the end of a factor are looked up on their own.
Factors are at least a window long and become duplicate spans; those of
neighbouring blocks join.

The index finds windows by 128 bits of hash, and the words of a factor and its
source are compared. Blocks that are equal as a whole are settled by 128 bits of
hash before texts are sent, and very common anchors are thinned out (``repeats``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from blackspot.llm.arrays import SECOND, WORDS, join_words, mix, range_hash, spread, sums, word_hashes, words
from blackspot.llm.common import documents, id_back, stored
from blackspot.llm.repeats import (WORD_UNIT, bytes_of, copies, each_slab, numbered, record, repeated_spans, span_cover, unpack, with_spans)

WINDOW = 20
GRAM = 6


def earliest(one: np.ndarray, two: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For every item the equal one with the smallest (document, place), which may be itself."""
    order = np.lexsort((place, doc, two, one))
    out = np.arange(len(order))
    if len(order):
        head = np.append(True, (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]]))
        out[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which byte ranges equal their partner."""
    out = a_end - a == b_end - b
    some = np.flatnonzero(out)
    owner, rank = spread((a_end - a)[some])
    wrong = data[a[some][owner] + rank] != data[b[some][owner] + rank]
    out[some[owner[wrong]]] = False
    return out


def factors(window: int):
    """Parses the blocks of whole buckets greedily against all earlier blocks of their bucket.

    The index holds every window of the blocks at the place where it stands first.
    The next window of a block that the index knows from an earlier place starts a
    factor, which goes on as long as the words of both go on alike; then the windows
    behind it, those across the factor's end first, are looked up again.
    Gives ``doc, s, e, from_doc, from_s``: the factor and its source, words compared.
    """
    def run(t: pa.RecordBatch) -> pa.RecordBatch:
        doc = t["doc"].to_numpy()
        place, count, _ = unpack(t["run"].to_numpy())
        data, offsets = bytes_of(t)
        starts, ends, first = words(data, offsets)
        h = word_hashes(data, starts, ends)
        owner, rank = spread(count)
        at = first[owner] + rank
        one, two = (mix(range_hash(sums(h, p), at, at + window, p)) for p in (WORDS, SECOND))
        source = earliest(one, two, doc[owner], place[owner] + rank)
        known = (doc[owner[source]] != doc[owner]) | ((place[owner] + rank)[source] != place[owner] + rank)
        n = len(known)
        ahead = np.append(np.where(known, np.arange(n), n), n)
        ahead = np.minimum.accumulate(ahead[::-1])[::-1]  # the next known window
        end = np.cumsum(count)
        found, cursor, limit = [], end - count, end
        while len(cursor):
            begin = ahead[cursor]
            open_ = begin < limit
            begin, limit = begin[open_], limit[open_]
            if not len(begin):
                break
            src, size, going = source[begin], np.ones(len(begin), np.int64), np.arange(len(begin))
            stop = end[owner[src]]
            while len(going):
                x, y = begin[going] + size[going], src[going] + size[going]
                on = (x < limit[going]) & (y < stop[going])
                x, y, going = x[on], y[on], going[on]
                going = going[(one[x] == one[y]) & (two[x] == two[y])]
                size[going] += 1
            last = size - 1 + window - 1
            right = same_bytes(data, starts[at[begin]], ends[at[begin] + last], starts[at[src]], ends[at[src] + last])
            found.append((begin[right], size[right], src[right]))
            cursor = np.where(right, begin + size, begin + 1)
            more = cursor < limit
            cursor, limit = cursor[more], limit[more]
        begin, size, src = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        s = (place[owner] + rank)[begin]
        return record("doc s e from_doc from_s", doc[owner[begin]], s, s + size - 1 + window, doc[owner[src]], (place[owner] + rank)[src])
    return run


def duplicate_spans(rows: DataFrame, twins: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Word spans ``(doc, s, e)`` that stand earlier in the corpus too, except in later copies of whole texts.

    ``rows`` is the output of ``numbered``, ``twins`` that of ``copies``.
    """
    parse = factors(window)
    return repeated_spans(rows, twins, WORD_UNIT, window, gram, False, lambda t: parse(t).select(["doc", "s", "e"]))


def remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, offsets in each_slab(b):
                starts, ends, first = words(data, offsets)
                later = lambda p: p["head"].is_valid().to_numpy(zero_copy_only=False) & (
                    p["head"].fill_null(0).to_numpy() != p["doc"].to_numpy())
                gone = span_cover(part, first, len(starts), window, later)
                removed = np.append(0, np.cumsum(gone))
                texts = join_words(data, starts[~gone], ends[~gone], first - removed[first])
                yield record("doc_id n_words n_removed kept", part["doc_id"], np.diff(first),
                             removed[first[1:]] - removed[first[:-1]], pa.array(texts, pa.binary()).cast(pa.string()))
    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every row of ``docs`` without the words of windows that stand earlier in the corpus.

    A window is ``window`` consecutive words of one document; it stands earlier
    in a document with a smaller doc_id or earlier in its own. Returns ``doc_id,
    n_words, n_removed, kept`` with the kept words joined by one space. A null,
    empty or short text loses nothing. A null doc_id comes before all others;
    rows that repeat a doc_id with another text count as further documents in the
    order of their hash, rows that repeat both as the same one. Other columns are
    not read; an empty table gives no rows.
    """
    rows = numbered(docs)
    twins = copies(rows)
    spans = duplicate_spans(rows, twins, window, gram)
    out = with_spans(rows, spans, twins).select("doc", "doc_id", "text", "head", "spans")
    return out.mapInArrow(remove(window), "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(documents(spark, sf_dir))
    return stored(kept.select(id_back(F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


OP1_SQL = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM w WHERE len(ws) >= 20),
keyed AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM win),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM keyed) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM dup),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM w),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_ USING (doc_id)"""
