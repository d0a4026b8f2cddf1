"""Exact and SimHash dedup, decontamination, and the pipeline."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from blackspot import joins
from blackspot.llm import decontaminate
from blackspot.runtime import cut
from blackspot.llm.decontaminate import contaminated, drop_contaminated, op2_decontaminate
from blackspot.llm.exact_dedup import chains, directory, exact_duplicates, keep_unique, op9_exact_dedup
from blackspot.llm.simhash import BITS, keep_one, masks, near_duplicates, near_links, op7_simhash_dedup, signed

SF = "/root/testdata/sf0.001"
LOWEST = -(1 << 63)
low = lambda d: LOWEST if d is None else d


def brute_exact(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(low(d))
    out = []
    for d, t, *_ in rows:
        g = groups[t or ""]
        keep = max(g)
        out.append((d, None if keep == LOWEST else keep, len(g), low(d) == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_duplicates(spark, table, odd):
    rows = odd() + [(200 + i, "copy") for i in range(300)] + [(None, "copy"), (700, "Copy"), (701, "copy ")]
    got = exact_duplicates(table(rows), capacity=4).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows)
    assert exact_duplicates(table([])).collect() == []


def test_exact_duplicates_of_split_keys(spark, table, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY", 4)  # keys with a quarter of the rows are dealt to several parts
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i % 90}") for i in range(200)]
    assert sorted(map(tuple, exact_duplicates(table(rows)).collect()), key=repr) == brute_exact(rows)


def test_directory_splits_full_buckets_only(spark):
    keys = spark.range(3000).select(F.shiftright(F.xxhash64("id"), 3).alias("key"))  # crowds half of all prefixes
    slots, bits = directory(keys, capacity=100)
    held = keys.join(slots, F.shiftrightunsigned("key", 64 - bits) == F.col("slot")).groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in held) == 3000 and all(r["count"] <= 100 or r["depth"] == bits for r in held)
    assert len({r["depth"] for r in held}) > 1


def test_collisions_are_chained():
    first = chains(np.array([1, 1, 1, 1, 2, 3, 3]), pa.array([b"x", b"y", b"x", b"y", b"x", b"z", b"z"], pa.large_binary()))
    assert first.tolist() == [0, 1, 0, 1, 4, 5, 5]


def test_keep_unique_has_all_columns(spark, table, odd):
    docs = table(odd())
    kept = keep_unique(docs)
    assert kept.columns == docs.columns
    want = [(r[0], r[1]) for r in odd() if (low(r[0]) == max(low(x[0]) for x in odd() if (x[1] or "") == (r[1] or "")))]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def fingerprint(text, width=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + width]).encode(), 42) for i in range(max(1, len(ws) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grouped(items, linked):
    """The least member of each item's component."""
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(items, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_masks_cover_every_pair(distance):
    families = [set(m) for m in masks(distance)]
    assert all(any(set(bits) <= m for m in families) for bits in combinations(range(BITS), min(distance, 2)))
    rng = random.Random(distance)
    assert all(any(set(bits) <= m for m in families) for bits in (rng.sample(range(BITS), distance) for _ in range(3000)))


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_connect_what_is_near(spark, distance):
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:
        for _ in range(12):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, distance + 2)))
            prints.add(p)
    prints |= {0, 1, 3, (1 << 64) - 1, (1 << 64) - 2}
    fps = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in near_links(fps, distance).collect()]
    near = lambda a, b: (a ^ b).bit_count() <= distance
    assert all(near(a, b) for a, b in links)
    pairs = {frozenset(x) for x in links}
    assert grouped(sorted(prints), near) == grouped(sorted(prints), lambda a, b: frozenset((a, b)) in pairs)


def test_near_duplicates(spark, table, odd):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") + str(i) for i in range(400)]
    rows = odd(5) + [(300 + i, " ".join(base[:200 + i] + [f"new{i}"] + base[201 + i:])) for i in range(25)]
    want = {}
    prints = [(low(d), fingerprint(t)) for d, t, *_ in rows]
    comp = grouped(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in prints:
        least[comp[f]] = min(least.get(comp[f], 1 << 63), d)
    want = sorted(((d, f"{fingerprint(t):016x}", None if least[comp[fingerprint(t)]] == LOWEST else least[comp[fingerprint(t)]])
                   for d, t, *_ in rows), key=repr)
    assert sorted(map(tuple, near_duplicates(table(rows)).collect()), key=repr) == want
    assert near_duplicates(table([])).collect() == []
    kept = keep_one(table(rows)).collect()
    assert {low(r.doc_id) for r in kept} == set(least.values())


def test_one_row_of_each_group_stays(spark, table):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(n))
    a, b, c, d = say(80), say(80), say(80), say(80)
    near = b.replace(" ", "  ") + "\n"  # the same words, so the same fingerprint
    rows = ([(3, near), (7, a), (7, b)] + [(None, c), (None, c), (None, " " + c)] + [(5, d), (5, d), (5, d + " "), (6, d)]
            + [(None, None), (None, ""), (2, ""), (None, None)])
    docs = table(rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    same = lambda t: (t or "").split()
    assert sorted((low(i), same(t)) for i, t in got) == sorted([(7, same(a)), (3, same(b)), (LOWEST, same(c)), (5, same(d)), (LOWEST, [])])
    assert all(x in rows for x in got)


def item_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    ws = item_words(text)
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)}


def brute_matches(docs, items):
    out = []
    for d, t, *_ in docs:
        for i, q in items:
            n = min(len(item_words(q)), 5)
            want, own = shingles(q, n) if n else set(), shingles(t, n)
            if want and i is not None and len(own & want) >= 0.8 * len(want) - 1e-9:
                out.append((low(d), i, len(own & want), len(want)))
    return sorted(set(out))


def test_contaminated(spark, table, odd):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 6, 9, 17, 40, 66, 300])))) for i in range(60)] + [
        (61, None), (62, ""), (None, "a b c d e f"), (63, "Ça ÉTÉ vu. Là-bas, hier soir!"), (64, "Là-bas!"), (64, "hier"), (64, "hier")]
    docs = odd(4)
    for i in range(120):
        k, text = rng.choice(items[:60])
        ws = text.split()
        for j in range(len(ws)):
            if rng.random() < rng.choice([0, 0.02, 0.1]):
                ws[j] = word()
        filler = lambda: " ".join(word() for _ in range(rng.choice([0, 10, 2000])))
        docs.append((1000 + i, f"{filler()}, {' '.join(ws).upper()}! {filler()}"))
    docs.append((5000, "x ça été vu là bas hier soir y"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    got = contaminated(table(docs), bench).collect()
    assert sorted({(r.doc, r.item, r.shared, r["size"]) for r in got}) == brute_matches(docs, items)
    held = {m[0] for m in brute_matches(docs, [(i, q) for i, q in items if len(item_words(q)) >= 5])}
    kept = drop_contaminated(table(docs), bench)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((d, t) for d, t, *_ in docs if low(d) not in held), key=repr)
    assert contaminated(table([]), bench).collect() == []
    assert contaminated(table(docs), bench.limit(0)).collect() == []
    assert drop_contaminated(table(docs), bench.limit(0)).count() == len(docs) and drop_contaminated(table([]), bench).collect() == []


def test_items_of_many_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 60)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 3000)
    monkeypatch.setattr(decontaminate, "LIST", 30)
    monkeypatch.setattr(joins, "HEAVY", 4)
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(n))
    same = say(12)
    items = [(i, same) for i in range(150)] + [(150 + i, say(rng.choice([2, 5, 8, 40, 90]))) for i in range(250)] + [(400, "one " * 4000)]
    items += items[100:200] + [(0, say(7)), (0, say(7))]
    docs = [(i, f"{say(30)} {rng.choice(items)[1]} {say(5)}") for i in range(150)] + [(None, same), (7, same), (7, same), (500, None), (501, "one " * 5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    _, texts = decontaminate.item_texts(bench, "item_id")
    blocks = texts.groupBy("bucket", "rows", "bytes").agg(F.count("no").alias("n"), F.sum(F.length("text")).alias("size"), F.max(F.length("text")).alias("last"))
    assert blocks.count() > 5 and blocks.filter("n > 60 or size > 3000 + last").isEmpty()
    got = contaminated(table(docs), bench).collect()
    found = Counter((r.doc, r.item, r.shared, r["size"]) for r in got)
    assert sorted(found) == brute_matches(docs, items)
    assert found[(LOWEST, 3, 8, 8)] == 1 and found[(7, 149, 8, 8)] >= 2


def test_items_of_few_shingles_are_found_for_certain():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abc") + str(rng.randrange(4)) for _ in range(n))
    texts = [say(n) for n in range(1, 37) for _ in range(6)]
    queries = decontaminate.Queries(list(range(len(texts))), [t.encode() for t in texts], 5, 0.8, True)
    docs = [f"{say(rng.randrange(40))} {t} {say(rng.randrange(40))}".strip() for t in texts] + texts
    data = np.frombuffer("".join(docs).encode(), np.uint8)
    got = queries.matches(data, np.append(0, np.cumsum([len(d) for d in docs])))
    assert sorted((d, i, s, int(queries.size[i])) for d, i, s in got) == brute_matches(list(enumerate(docs)), list(enumerate(texts)))


@pytest.mark.parametrize("query", [op7_simhash_dedup, op9_exact_dedup, op2_decontaminate])
def test_queries_on_the_tables(spark, query):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = sorted(map(tuple, query(spark, SF).collect()), key=repr)
    if query is op9_exact_dedup:
        assert rows == brute_exact(docs)
    elif query is op2_decontaminate:
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        assert sorted(r[:4] for r in rows) == brute_matches(docs, items)
    else:
        prints = {d: fingerprint(t) for d, t in docs}
        comp = grouped(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
        least = {}
        for d, f in prints.items():
            least[comp[f]] = min(least.get(comp[f], d), d)
        assert rows == sorted(((d, f"{f:016x}", least[comp[f]]) for d, f in prints.items()), key=repr)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        seen.append({r.doc_id: r.text for r in frame.collect()})
        if name != "sentencepiece":
            assert frame.columns == docs.columns
    all_docs = {r.doc_id: r.text for r in docs.collect()}
    spoken, unique, single, clean, coded = seen
    assert all(spoken[d] == all_docs[d] for d in spoken) and len(spoken) >= 0.98 * len(all_docs)
    last = {}
    for d, t in spoken.items():
        last[t] = max(d, last.get(t, d))
    assert unique == {d: t for t, d in last.items()}
    prints = {d: fingerprint(t) for d, t in unique.items()}
    comp = grouped(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, f in prints.items():
        least[comp[f]] = min(least.get(comp[f], d), d)
    assert set(single) == set(least.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == set(single) - {m[0] for m in brute_matches(single.items(), items)}
    assert coded == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(clean)


def test_pipeline_of_odd_rows(spark, table, odd):
    frame = table([(*r, "en") if len(r) < 3 else r for r in odd()])
    held = lambda df: Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))
    before = held(frame)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = cut(stage(spark, frame, SF))
        after = held(frame)
        assert after and after <= before and frame.columns[:2] == ["doc_id", "text"]
        if name == "exact_dedup":
            assert {r[1] or "" for r in after} == {r[1] or "" for r in before}
        before = after
    coded = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r.doc_id, r.text) for r in coded) == Counter((r[0], library.decode(library.encode(r[1] or ""))) for r in before.elements())
    empty = table([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []
