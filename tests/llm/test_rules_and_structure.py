"""Whitening, quality rules and conversation repair."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blackspot import joins
from blackspot.llm.conversations import (OP13_SQL, Grammar, SYMBOLS, damaged, op13_conversation_repair, repair_report, repaired, terminal)
from blackspot.llm.quality_rules import OP12_SQL, RULES, Rule, compile_rules, op12_quality_rules, quality
from blackspot.llm.whitening import dqds, fit, identity_error, op11_embedding_whitening, singular, whiten

SF = "/root/testdata/sf0.001"
BLANK = set("\x20\t\n\x0b\x0c\r")


# Whitening

def check_vectors(r):
    values, z = singular(r)
    gram = r.T @ r
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.abs(values[:len(want)] - want).max(initial=0) <= 1e-13 * want.max(initial=0)
    assert np.abs(z.T @ z - np.eye(len(z))).max() < 1e-11
    assert np.abs(gram @ z - z * values).max() <= 1e-12 * max(values.max(), 1e-300)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_singular_vectors_of_random_triangles(size):
    check_vectors(np.linalg.qr(np.random.default_rng(size).standard_normal((2 * size, size)), mode="r"))


def test_singular_vectors_of_hard_triangles():
    rng = np.random.default_rng(0)
    turn = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]
    missing = rng.standard_normal((50, 20))
    missing[:, 5], missing[:, 7] = missing[:, 4], 0
    for a in (np.eye(6), np.diag([3.0, 3, 1, 0]), np.zeros((4, 4)), missing, (turn(30) * np.repeat([1.0, 2], 15)) @ turn(30),
              np.tile(rng.standard_normal((1, 16)), (40, 1)), np.diag(np.abs(np.arange(-10, 11)) + 0.5) + np.diag(np.ones(20), 1)):
        check_vectors(np.linalg.qr(a, mode="r"))


def test_small_values_keep_their_digits():
    """Graded columns: a method that squares the matrix loses all digits of the small values."""
    r = np.linalg.qr(np.random.default_rng(2).standard_normal((200, 12)) * np.logspace(0, -11, 12), mode="r")
    values, _ = singular(r)
    assert np.abs(values / np.linalg.svd(r, compute_uv=False) ** 2 - 1).max() < 1e-9


def test_dqds_splits_where_a_coupling_is_zero():
    assert sorted(dqds([4.0, 9.0, 1.0], [0.0, 0.0])) == [1.0, 4.0, 9.0]


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(0)
    z = (n * x - sums) / n
    values, u = np.linalg.eigh(z.T @ z / n)
    values, u = values[::-1], u[:, ::-1]
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()], (z @ u / np.sqrt(values))[:, :k], values[:k] / values.sum()


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = (rng.standard_normal((400, 5)) @ rng.standard_normal((5, 5))).tolist()
    good += [good[0]] * 200  # a third of all rows is one vector
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(None, good[3], None, None), (3, good[3], "y", 2)] + [(1000 + i, v, "z", 3) for i, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation string, n long").repartition(40)
    model = fit(table, 4)
    got = whiten(table, model).collect()
    assert len(got) == len(good) + 2 and sum(r["vec_id"] is None for r in got) == 1
    deviation, white, share = brute_whitening(good + [good[3]] * 2, 4)
    by_id = {r["vec_id"]: r for r in got}
    assert [int(by_id[i]["deviation"]) for i in range(600)] == deviation[:600]
    mine = np.array([by_id[i]["whitened"] for i in range(600)])
    sign = np.sign((mine * white[:600]).sum(0))
    assert np.abs(mine - white[:600] * sign).max() < 1e-9
    assert np.abs(model.values / model.trace / share - 1).max() < 1e-12 and identity_error(table, model) < 1e-10


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert fit(spark.createDataFrame([], schema)) is None
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], schema)
    model = fit(same)
    assert model.n == 5 and not model.values.any() and identity_error(same, model) == 0
    assert all(r["deviation"] == 0 and r["whitened"] == [0.0, 0.0, 0.0] for r in whiten(same, model).collect())
    flat = spark.createDataFrame([(i, [float(i % 7), 2.0 * (i % 7), float(i * i % 11)]) for i in range(60)], schema)
    model = fit(flat)  # two of three dimensions say the same
    assert (model.values > 0).tolist() == [True, True, False] and identity_error(flat, model) < 1e-10


def test_op11_columns(spark):
    got = op11_embedding_whitening(spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    rows = got.toPandas()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    deviation, white, share = brute_whitening(np.stack(vectors.embedding), 32)
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[vectors.vec_id].to_numpy()
    assert wide.shape == (len(vectors), 32) and (rows.groupby("vec_id").deviation.first().loc[vectors.vec_id] == deviation).all()
    assert np.abs(np.abs(wide) - np.abs(white)).max() < 1e-6
    assert np.abs(rows.groupby("component").explained.first().to_numpy() / share - 1).max() < 1e-9 and rows.identity_error.max() < 1e-9


# Quality rules

def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [l for l in text.split("\n") if set(l) - BLANK]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    again = {w for w in set(windows) if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_quality_measures(spark, table, odd):
    rng = random.Random(3)
    rows = odd() + [(100 + i, "\n".join(" ".join(rng.choice("ab cd# e$ ** F") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(30)))) for i in range(40)]
    rows += [(200, "a b c d e f g"), (201, "a b c d e f g h"), (202, "a b c d e f g h " * 2), (203, "x " * 9), (204, "x " * 30), (205, "one\n\none\n \n \n one")]
    got = quality(table(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "broken").collect()
    mine = sorted(((*r[:6], bool({"few_words", "repeated_words"} & set(r["broken"]))) for r in got), key=repr)
    assert mine == sorted(((d, *brute_quality(t)) for d, t, *_ in rows), key=repr)
    assert quality(table([])).collect() == []


def test_a_rule_table_of_ones_own(spark):
    rules = [Rule("short", "a", "one", 3000, None), Rule("steep", "a", "b", None, 500)]
    rows = spark.createDataFrame([(2, 0), (3, 6), (4, 4), (0, 0)], "a long, b long")
    broken = [r[0] for r in rows.select(compile_rules(rules, F.col)).collect()]
    assert broken == [["short", "steep"], [], ["steep"], ["short"]]
    assert [r[0] for r in rows.select(compile_rules([], F.col)).collect()] == [[]] * 4
    assert len({r.name for r in RULES}) == len(RULES)


def test_clean_documents_are_kept(spark):
    """Labelled quality 1 and 20 words or more stay but for very few; labelled quality 0 go."""
    kept = op12_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    good = kept.filter("quality = 1 and n_words >= 20")
    bad = kept.filter("quality = 0 and toxic = 0")
    assert good.filter("kept").count() >= 0.99 * good.count() and bad.filter("kept").count() <= 0.1 * bad.count()


def test_quality_is_one_projection_without_python(spark, table):
    plan = quality(table([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# Conversations

def brute_repair(rows):
    """Per conversation: report and repaired rows, by the same search row by row with whole strings."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    goes = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    free = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.sha256(z[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        seen, kinds = set(), []
        for _, r, x in own:
            core = [ch for ch in x if ch not in BLANK]
            kinds.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((r, x))

        def closed(ways):
            ways = dict(ways)
            for _ in range(4):
                for s, (k, a, o) in list(ways.items()):
                    way = (k + 3, a + "I", o + ((free[s], ""),))
                    end = goes[s, free[s][0]]
                    if end not in ways or way[:2] < ways[end][:2]:
                        ways[end] = way
            return ways

        ways = {0: (0, "", ())}
        for (_, r, x), kind in zip(own, kinds):
            after = {}
            for s, (k, a, o) in closed(ways).items():
                more = 3 if kind == "truncated" else 0
                offers = [(s, (k + 4, a + "D", o))]
                if kind not in ("blank", "duplicate"):
                    offers.append((goes[s, free[s][0]], (k + 3 + more, a + "R", o + ((free[s], x),))))
                    if (s, r[:1]) in goes:
                        offers.append((goes[s, r[:1]], (k + more, a + "K", o + ((r, x),))))
                for end, way in offers:
                    if end not in after or way[:2] < after[end][:2]:
                        after[end] = way
            ways = after
        cost, audit, rest = min((w for s, w in closed(ways).items() if s in (0, 3)), key=lambda w: w[:2])
        report = (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
                  sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit,
                  hashlib.sha256("\n".join(f"{r}:{x}" for r, x in rest).encode()).hexdigest())
        out[c] = report, rest
    return out


CONV = "conv_id long, turn long, role string, text string"


def conversations(seed, n=60, longest=14):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = [(c, pick(i, i, i, i + 1, None), pick("user", "assistant", "user", "assistant", "system", "tool", "", None, "User"),
             pick("Yes.", "No", "", " \t", "Why?", "One two.", None, "end! ", "ä…"))
            for c in range(n) for i in range(rng.randrange(longest))]
    return rows + [(None, i, "user", f"t{i}.") for i in range(5)] + rows[:7]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in ("conv", "h", "n", "kind", "at", "rows", "symbols", "place")})


@pytest.mark.parametrize("size, pairs, rounds", [(1024, 128, 10), (3, 2, 4), (1, 1, 0)])
def test_repair_equals_the_search_row_by_row(spark, size, pairs, rounds):
    rows = conversations(size)
    table = clashing(spark.createDataFrame(rows, CONV))
    want = brute_repair(rows)
    got = {r["conv_id"]: tuple(r) for r in repair_report(table, None, size, pairs, rounds).collect()}
    assert got == {c: report for c, (report, _) in want.items()}
    parts = {}
    for r in sorted(repaired(table, size, pairs, rounds).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        parts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert r["place"] == len(parts[r["conv_id"]]) - 1 and r["edit"] in "KRI"
    assert parts == {c: list(rest) for c, (_, rest) in want.items() if rest}


def test_repair_of_one_conversation_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY", 4)
    rng = random.Random(1)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"t{i}!", "cut"])) for i in range(1500)]
    rows += [(7, 3, "user", "Same.")] * 700 + [(8 + i % 40, i // 40, "user" if i // 40 % 2 == 0 else "assistant", f"x{i}.") for i in range(160)]
    got = {r["conv_id"]: tuple(r) for r in repair_report(spark.createDataFrame(rows, CONV).repartition(16), size=64).collect()}
    assert got == {c: report for c, (report, _) in brute_repair(rows).items()}


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], CONV)
    assert repair_report(none).collect() == [] and repaired(none).collect() == []
    known = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, repair_report(none, known).collect()), key=repr) == sorted([(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (1, None)], key=repr)


def test_rule_matrices_equal_products_of_terminals():
    grammar, rng = Grammar(), random.Random(0)
    words = {i: [i] for i in range(len(SYMBOLS))}
    for _ in range(40):
        left, right = rng.randrange(len(words)), rng.randrange(len(words))
        if len(words[left]) + len(words[right]) < 40:
            words[grammar.add(left, right)] = words[left] + words[right]
    for s, flat in words.items():
        cost, texts = grammar.matrix([s], grammar.audit)
        plain = grammar.matrix(flat, grammar.audit)
        assert (cost == plain[0]).all() and texts == plain[1]
    assert terminal("-")[1][0][0] == b"D"


def damage_by_hand(rows):
    out = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        out += [(c, t, "user" if fault == 4 else r, x)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def test_damage_and_sql(spark, tmp_path):
    rows = conversations(9, 150)
    table = spark.createDataFrame(rows, CONV)
    assert sorted(map(tuple, damaged(table).collect()), key=repr) == sorted(damage_by_hand(rows), key=repr)
    table.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = op13_conversation_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(OP13_SQL).fetchall(), key=repr)
    assert sorted(map(tuple, op12_quality_rules(spark, SF).collect())) == sorted(con.execute(OP12_SQL).fetchall())
