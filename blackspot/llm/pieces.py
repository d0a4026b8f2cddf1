"""SentencePiece encoding and decoding by vectorised merge rounds.

A model of this family keeps text as it is, puts one space before it, writes
spaces as U+2581, merges pairs of symbols by the score of the piece they give,
and writes characters without a piece as bytes. No piece has a space after
another character, so a text falls into words (spaces, then other characters)
that are merged on their own, and equal words of a slab are merged once.

The symbols of all words stand in one flat array. In each round every word finds
the least rank among its adjacent pairs and merges all pairs of that rank from
the left; the array is then compacted, and words without a pair leave it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blackspot.llm.arrays import BYTES, SECOND, mix, range_hash, slabs, spread, sums
from blackspot.llm.common import documents, id_back, id_key, in_parts, stored

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NO_PAIR = np.iinfo(np.int32).max
PROBES = ("", " ", "a  b ", "\t\r\n", "x ﬁⅧé", "日\U0001f389\U00010348\x00", " " * 40 + "z")


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL)


class Pieces:
    """The tables of a model, as arrays."""

    def __init__(self, path: str):
        import sentencepiece
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(n)]
        byte = [library.is_byte(i) for i in range(n)]
        plain = [i for i in range(n) if not (byte[i] or library.is_control(i) or library.is_unknown(i))]
        ids = {names[i]: i for i in plain}
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("pieces with a space after another character are not supported")
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if byte[i]:
                self.byte_id[int(names[i][1:-1], 16)] = i
        # Characters of longer pieces that are no piece themselves get numbers above the pieces.
        symbol = dict(ids)
        for ch in sorted({c for p in ids for c in p} - set(ids)):
            symbol[ch] = n + len(symbol) - len(ids)
        self.symbols = n + len(symbol) - len(ids)
        self.of_char = -np.arange(0x110000, dtype=np.int32) - 1
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.char_of = np.zeros(self.symbols, np.int32)
        for p, i in symbol.items():
            self.char_of[i] = ord(p[0])
        scores = sorted({library.get_score(i) for i in plain}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.rank = np.full(self.symbols + 1, NO_PAIR, np.int32)
        for i in plain:
            self.rank[i] = order[library.get_score(i)]
        pairs = {(symbol[p[:k]], symbol[p[k:]]): ids[p] for p in ids for k in range(1, len(p))
                 if p[:k] in symbol and p[k:] in symbol}
        left, right = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
        merged = np.array(list(pairs.values()), np.int64)
        # A rank whose merge can open a pair of the same or a better rank is merged one by one.
        self.careful = np.zeros(len(scores) + 1, bool)
        for side in (left, right):
            bad = (side < n) & (self.rank[merged] <= self.rank[side]) & np.isin(side, merged)
            self.careful[self.rank[side[bad]]] = True
        self.table(left * self.symbols + right, merged)
        # If runs of spaces merge last and, from the left, into the longest piece of spaces,
        # a long run can be cut into such pieces beforehand.
        runs = [p for p in ids if len(p) > 1 and set(p) == {SPACE}]
        self.run = longest = max(map(len, runs), default=0)
        alone = np.full(3 * longest, self.of_char[ord(SPACE)], np.int32)
        if {int(self.rank[ids[p]]) for p in runs} != {len(scores) - 1} or (
                merge_words(alone, np.zeros(3 * longest, np.int64), self)[0].tolist() != 3 * [ids[SPACE * longest]]):
            self.run = 0
        known = set(plain)
        text = [bytes([int(name[1:-1], 16)]) if byte[i] else name.replace(SPACE, " ").encode() if i in known
                else b" \xe2\x81\x87 " if library.is_unknown(i) else b"" for i, name in enumerate(names)]
        self.piece_size = np.array([len(x) for x in text], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.is_byte = np.array(byte)
        self.opens = np.array([i in known and t[:1] == b" " for i, t in enumerate(text)])
        for probe in PROBES:
            got = encode_array(pa.array([probe]), self)[0].as_py()
            if got != library.encode(probe) or decode_array(pa.array([got], pa.list_(pa.int32())), self)[0].as_py() != library.decode(got):
                raise ValueError(f"the model in {path} has settings that are not supported")

    def table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the pairs, filled in rounds."""
        self.bits = max(8, int(8 * len(keys)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full((1 << self.bits) + 64, -1, np.int32)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] += 1
            if len(todo) and slot[todo].max() >= len(self.keys):
                raise ValueError("pair table overflow")

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, or -1."""
        out = np.full(len(a), -1, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[todo].astype(np.int64) * self.symbols + b[todo]
        slot = self.slot(key)
        while len(todo):
            found = self.keys[slot]
            out[todo] = np.where(found == key, self.values[slot], out[todo])
            more = (found != key) & (found >= 0)
            todo, key, slot = todo[more], key[more], slot[more] + 1
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def merge_words(symbols: np.ndarray, word: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their words after all merges; ``word`` is sorted on both sides."""
    done_symbols, done_words = [], []
    while len(symbols):
        joined = np.full(len(symbols), -1, np.int32)
        joined[:-1] = p.merge(symbols[:-1], symbols[1:])
        joined[:-1][word[1:] != word[:-1]] = -1
        rank = p.rank[joined]
        rank[joined < 0] = NO_PAIR
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(heads, len(word)))
        least = np.minimum.reduceat(rank, heads)
        live = np.repeat(least < NO_PAIR, sizes)
        done_symbols.append(symbols[~live])
        done_words.append(word[~live])
        best = np.repeat(least, sizes)
        chosen = live & (rank == best)
        # Of overlapping pairs every second one is merged, from the left.
        place = np.arange(len(symbols))
        start = np.maximum.accumulate(np.where(chosen & ~np.append(False, chosen[:-1]), place, 0))
        chosen &= (place - start) % 2 == 0
        careful = p.careful[np.minimum(best, len(p.careful) - 1)] & live
        if careful.any():
            at = np.flatnonzero(chosen & careful)
            first = np.append(True, word[at[1:]] != word[at[:-1]])
            chosen[at[~first]] = False
        symbols = np.where(chosen, joined, symbols)
        keep = live & ~np.append(False, chosen[:-1])
        symbols, word = symbols[keep], word[keep]
    symbols, word = np.concatenate([np.zeros(0, np.int32), *done_symbols]), np.concatenate([np.zeros(0, np.int64), *done_words])
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte each starts at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    more = (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(more == 0, lead, lead & (0x3F >> more))
    padded = np.append(data, np.zeros(3, np.uint8))
    for k in (1, 2, 3):
        point = np.where(more >= k, point << 6 | (padded[at + k] & 0x3F), point)
    return point, at


def encode_slab(data: np.ndarray, offsets: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slab, one after the other, and the number of each text."""
    size = np.diff(offsets)
    full = size > 0
    # One space before each text that is not empty.
    padded = np.insert(data, offsets[:-1][full], 0x20)
    begin = offsets + np.append(0, np.cumsum(full))
    n = len(padded)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
    head = np.zeros(n + 1, bool)
    head[begin[:-1][full]] = True
    space = padded == 0x20
    first = space & (np.append(True, ~space[:-1]) | head[:-1])
    place = np.arange(n)
    in_run = place - np.maximum.accumulate(np.where(first, place, 0))
    starts = np.flatnonzero(space & (in_run % p.run == 0) if p.run else first)
    ends = np.append(starts[1:], n)
    values = padded.astype(np.uint64) + np.uint64(1)
    total, second = sums(values, BYTES), sums(values, SECOND)
    key = mix(range_hash(total, starts, ends, BYTES) + (ends - starts).astype(np.uint64))
    check = range_hash(second, starts, ends, SECOND)
    _, unique, member = np.unique(key, return_index=True, return_inverse=True)
    odd = np.flatnonzero(check != check[unique[member]])  # different words under one key stand for themselves
    member[odd] = len(unique) + np.arange(len(odd))
    unique = np.append(unique, odd)
    length = (ends - starts)[unique]
    owner, rank = spread(length)
    points, at = code_points(padded[starts[unique][owner] + rank])
    points = np.where(points == 0x20, ord(SPACE), points)
    symbols, word = merge_words(p.of_char[points], owner[at], p)
    # Characters without a piece become their bytes.
    point = np.where(symbols < 0, -symbols - 1, p.char_of[np.maximum(symbols, 0)])
    raw = (symbols < 0) | (symbols >= p.n)
    width = np.where(raw, 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000), 1)
    item, k = spread(width)
    ids = symbols[item]
    pos = np.flatnonzero(raw[item])
    c, w, j = point[item][pos].astype(np.int64), width[item][pos], k[pos]
    low = c >> 6 * (w - 1 - j)
    byte = np.where(w == 1, c, np.where(j == 0, low | (0xF00 >> w & 0xFF), low & 0x3F | 0x80))
    ids[pos] = p.byte_id[byte]
    per = np.bincount(word[item], minlength=len(unique))
    from_ = np.cumsum(per) - per
    who, rank = spread(per[member])
    text = np.searchsorted(begin, starts, "right") - 1
    return ids[from_[member][who] + rank], np.bincount(text, weights=per[member], minlength=len(size)).astype(np.int64)


def encode_array(texts: pa.Array, p: Pieces) -> pa.Array:
    if pc.any(pc.match_substring(texts, SPACE)).as_py():
        texts = pc.replace_substring(texts, SPACE, " ")
    parts = [encode_slab(data, offsets, p) for _, data, offsets in slabs(texts)]
    ids = np.concatenate([np.zeros(0, np.int32), *[x for x, _ in parts]])
    counts = np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids.astype(np.int32)))


def decode_bytes(ids: list[int], p: Pieces) -> bytes:
    """One text with byte pieces that form no characters: each such byte becomes U+FFFD."""
    out, run = [], bytearray()

    def flush():
        while run:
            for k in (1, 2, 3, 4):
                try:
                    bytes(run[:k]).decode()
                except UnicodeDecodeError:
                    continue
                if k <= len(run):
                    out.append(bytes(run[:k]))
                    del run[:k]
                    break
            else:
                out.append("�".encode())
                del run[:1]

    for i in ids:
        piece = p.piece_bytes[p.piece_at[i]:p.piece_at[i] + p.piece_size[i]].tobytes()
        if p.is_byte[i]:
            run += piece
        else:
            flush()
            out.append(piece)
    flush()
    text = b"".join(out)
    return text[1:] if ids and p.opens[ids[0]] else text


def decode_array(lists: pa.Array, p: Pieces) -> pa.Array:
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    out = []
    row, n = 0, len(lists)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 19), "right")) - 1)
        own = ids[offsets[row]:offsets[end]]
        size = p.piece_size[own]
        who, rank = spread(size)
        data = p.piece_bytes[p.piece_at[own][who] + rank].tobytes()
        at = np.append(0, np.cumsum(size))[offsets[row:end + 1] - offsets[row]]
        for k in range(end - row):
            some = own[offsets[row + k] - offsets[row]:offsets[row + k + 1] - offsets[row]]
            text = data[at[k] + bool(len(some) and p.opens[some[0]]):at[k + 1]]
            try:
                out.append(text.decode())
            except UnicodeDecodeError:
                out.append(decode_bytes(some.tolist(), p).decode())
        row = end
    return pa.array(out, pa.string())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc, ids)`` for every row of ``docs``: the ids of its whole text, without begin or end.

    A null text counts as empty and has no ids. ``doc`` is the doc_id (see
    ``id_key``). Other columns are not read; an empty table gives no rows.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for b in in_parts(batches):
            yield pa.RecordBatch.from_arrays([b["doc"], encode_array(b["text"], p)], names=["doc", "ids"])
    return docs.select(id_key().alias("doc"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc, ids, text)`` for rows ``(doc, ids)``; null ids give an empty text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for b in in_parts(batches):
            yield pa.RecordBatch.from_arrays([b["doc"], b["ids"], decode_array(b["ids"], p)], names=["doc", "ids", "text"])
    return coded.select("doc", "ids").mapInArrow(run, "doc long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc, ids, text)`` for every row of ``docs``: its ids and what they decode to, in one pass of the tasks.

    The same as ``decode(encode(docs))``, with half the Python workers.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for b in in_parts(batches):
            ids = encode_array(b["text"], p)
            yield pa.RecordBatch.from_arrays([b["doc"], ids, decode_array(ids, p)], names=["doc", "ids", "text"])
    rows = docs.select(id_key().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc long, ids array<int>, text string")


def digests() -> list[Column]:
    return [id_back(F.col("doc")).alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
            F.sha2("text", 256).alias("decoded_sha256")]


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(round_trip(documents(spark, sf_dir)).select(*digests()))
