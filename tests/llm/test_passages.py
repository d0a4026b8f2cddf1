"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from blackspot.llm import repeats, suffix_dedup
from blackspot.llm.arrays import WORDS, anchors, mix, sliding_min
from blackspot.llm.rlz_dedup import op1_substring_dedup, substring_dedup
from blackspot.llm.suffix_dedup import COVER, LENGTH, PERIOD, Block, op10_suffix_dedup, repeated

LOWEST = -(1 << 63)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_words(rows, window):
    """Rows as (doc_id, n_words, n_removed, kept), documents being the different (doc_id, text)."""
    docs = sorted({(LOWEST if d is None else d, t or "") for d, t, *_ in rows}, key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest()))
    first, gone = {}, {}
    for d, t in docs:
        ws = words_of(t)
        for s in range(len(ws) - window + 1):
            k = tuple(ws[s:s + window])
            if k in first:
                gone.setdefault((d, t), set()).update(range(s, s + window))
            first.setdefault(k, (d, s))
    out = []
    for d, t, *_ in rows:
        ws, g = words_of(t), gone.get((LOWEST if d is None else d, t or ""), set())
        out.append((d, len(ws), len(g), " ".join(w for i, w in enumerate(ws) if i not in g)))
    return sorted(out, key=repr)


def passages(seed, n, vocabulary, longest):
    """Documents made of shared passages and noise."""
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, longest))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.6 else " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, longest)))
                 for _ in range(rng.randrange(1, 5))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed,window,gram,crowd", [(1, 5, 2, 1000), (2, 8, 3, 2), (3, 20, 6, 1000), (4, 20, 6, 3)])
def test_substrings_equal_brute_force(spark, table, odd, monkeypatch, seed, window, gram, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = passages(seed, 60, ["a", "b", "ça", "dd", "E"], 40) + [((100 + i) if d is not None else None, t) for i, (d, t, *_) in enumerate(odd(seed))]
    out = substring_dedup(table(rows), window, gram).collect()
    got = sorted([(None if r.doc_id == LOWEST else r.doc_id, r.n_words, r.n_removed, r.kept) for r in out], key=repr)
    assert got == brute_words(rows, window)


def test_repeated_ids_and_rows(spark, table):
    text = " ".join(map(str, range(30)))
    rows = [(1, text), (1, text), (1, "before " + text), (2, text), (0, "short")]
    out = substring_dedup(table(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute_words(rows, 20)


def test_empty_tables(spark, table):
    assert substring_dedup(table([])).collect() == []
    assert suffix_dedup.suffix_dedup(table([])).collect() == []


def brute_bytes(rows, length):
    seen = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen[b[s:s + length]] = seen.get(b[s:s + length], 0) + 1
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((d, len(b), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,length,gram,crowd", [(1, 93, 16, 1000), (2, 100, 32, 2), (3, 400, 64, 1000), (4, 400, 64, 3)])
def test_suffixes_equal_brute_force(spark, table, odd, monkeypatch, seed, length, gram, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = passages(seed, 60, ["a", "b", "ça", "dd"], 200) + [(500 + i, t) for i, (d, t, *_) in enumerate(odd(seed))] + [(None, "a" * 1200)]
    out = suffix_dedup.suffix_dedup(table(rows), length, gram).collect()
    got = [(None if r.doc_id == LOWEST else r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in out]
    assert sorted(got, key=repr) == brute_bytes(rows, length)


def test_lengths_out_of_range_are_refused(spark, table):
    for length, gram in ((92, 16), (1024, 16), (400, 401)):
        with pytest.raises(ValueError):
            suffix_dedup.suffix_dedup(table([(1, "x")]), length, gram)


def test_cover_reaches_every_pair():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_comparison_is_lexicographic():
    rng = np.random.default_rng(0)
    text = np.tile(rng.integers(97, 99, 700, dtype=np.uint8), 4)
    text[rng.integers(0, len(text), 12)] = 99
    block, raw = Block(text, LENGTH), text.tobytes()
    a, b = rng.integers(0, len(text) - LENGTH, (2, 4000))
    b[::3] = np.minimum(a[::3] + 700, len(text) - LENGTH)
    want = [(raw[i:i + LENGTH] > raw[j:j + LENGTH]) - (raw[i:i + LENGTH] < raw[j:j + LENGTH]) for i, j in zip(a, b)]
    assert block.compare(a, b).tolist() == want and 0 in want
    places = np.arange(len(text) - LENGTH)
    strings = [raw[i:i + LENGTH] for i in places]
    assert repeated(block, places, places * 0).tolist() == [strings.count(s) > 1 for s in strings]


def test_sliding_minimum_and_anchors():
    rng = np.random.default_rng(1)
    for n, width in ((1, 1), (5, 9), (100, 7), (64, 64)):
        values = rng.integers(0, 50, n).astype(np.uint64)
        assert sliding_min(values, width).tolist() == [min(values[i:i + width]) for i in range(n - width + 1)]
    symbols = mix(rng.integers(0, 3, 300).astype(np.uint64))
    first = np.array([0, 0, 4, 120, 300])
    seq, start, count, key, place = anchors(symbols, first, 10, 3, WORDS)
    windows = [(s, p) for s, a, n in zip(seq, start, count) for p in range(a, a + n)]
    assert windows == [(s, p) for s in range(4) for p in range(first[s], first[s + 1] - 9)]
    assert all(a + n - 1 <= x <= a + 7 for a, n, x in zip(start, count, place))
    chosen = {}
    for s, a, n, k, x in zip(seq, start, count, key, place):
        for p in range(a, a + n):
            assert chosen.setdefault(tuple(symbols[p:p + 10]), (k, x - p)) == (k, x - p)


@pytest.mark.parametrize("query", [op1_substring_dedup, op10_suffix_dedup])
def test_queries_cover_the_table(spark, query):
    rows = query(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    if query is op10_suffix_dedup:
        want = {d: hashlib.sha256(kept).hexdigest() for d, _, _, kept in brute_bytes(docs.items(), LENGTH)}
    else:
        want = {d: hashlib.sha256(kept.encode()).hexdigest() for d, _, _, kept in brute_words(docs.items(), 20)}
    assert {r.doc_id: r.kept_sha256 for r in rows} == want


def hot_passage(n, longer):
    """``n`` documents of random words around one passage, and as many with two of three phrases in it changed."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passage = [word() for _ in range(longer)]
    rows = []
    for i in range(n):
        own = list(passage)
        if i % 3 == 0:
            own[longer // 2] = f"id{i}"
        rows.append((i, " ".join([*(word() for _ in range(rng.randrange(30))), *own, *(word() for _ in range(rng.randrange(30)))])))
    return rows


@pytest.mark.parametrize("longer", [25, 90, 200])
def test_a_passage_of_very_many_documents(spark, table, longer):
    """More places than ``CROWD``: whole results, and every 400-byte repeat found (recall 1)."""
    rows = hot_passage(1600, longer)
    out = substring_dedup(table(rows).repartition(16)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=repr) == brute_words(rows, 20)
    out = suffix_dedup.suffix_dedup(table(rows).repartition(16)).collect()
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in out]
    assert sorted(got, key=repr) == brute_bytes(rows, LENGTH)


def test_rows_sent_do_not_depend_on_the_size_of_a_group(spark, table, monkeypatch):
    sent, made = [], []
    plain, cut = repeats.thinned, repeats.cut
    monkeypatch.setattr(repeats, "thinned", lambda crowded, *more: sent.append(crowded.count()) or plain(crowded, *more))
    monkeypatch.setattr(repeats, "cut", lambda df, *a, **b: made.append(cut(df, *a, **b)) or made[-1])
    rows = hot_passage(1600, 120)
    suffix_dedup.suffix_dedup(table(rows).repartition(16)).collect()
    parts = [t for t in made if t.columns == "key one two doc run crowd text".split()]
    runs_ = parts[0].count()
    assert sent[0] > 1000 and all(t.count() <= 4 * runs_ for t in parts[1:])


def test_factors_say_where_they_come_from():
    import pyarrow as pa
    from blackspot.llm.repeats import pack
    from blackspot.llm.rlz_dedup import factors
    ws = [f"w{i}" for i in range(30)]
    text = lambda *parts: " ".join(w for p in parts for w in p).encode()
    # 5-word windows of one bucket: a block at document 1, another that has its first 12 words, then 9 of its last after a gap.
    blocks = [(1, ws), (2, ws[:12] + ["gap"] + ws[21:])]
    t = pa.RecordBatch.from_arrays([pa.array([9, 9]), pa.array([d for d, _ in blocks]),
                                    pa.array(pack(np.array([100, 50]), np.array([26, 18]))), pa.array([text(b) for _, b in blocks], pa.binary())],
                                   names=["key", "doc", "run", "text"])
    got = [tuple(r.values()) for r in factors(5)(t).to_pylist()]
    assert got == [(2, 50, 62, 1, 100), (2, 63, 72, 1, 121)]
