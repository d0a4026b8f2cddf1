"""License scans: exact phrases, and an exact set-similarity join with license templates.

A template is met where a stretch of words about as long as itself (``SLACK`` words
more) holds at least the threshold of its different words, and all words that tell
it from templates much like it: a general license is not the lesser one without
"lesser". Lines do not matter, so wrapped text is found, and words scattered over a
long text are not.

Text blocks are overlapping stretches of words across line ends; every place where
a template could be met lies whole in one of them. The join finds every pair of
block and template without looking at all: words are ordered by how often they
stand in the corpus, rarest first. A template that shares enough words with a block shares
one of its first few with the first few of the block (prefix filter); the block
must be long enough (length filter); and the places of the shared word in both
orders must leave room for enough further ones (positional filter). What is left
is verified word by word.

All steps are DataFrame expressions. Templates are a parameter; only their words
are ever collected, in the plan or on the driver.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blackspot.llm.common import documents, id_back, id_key
from blackspot.llm.url_filter import LOWER, UPPER

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (phrase, label)
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: (label, text); a label may have several.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("proprietary", "all rights reserved no part may be reproduced without permission"),
]
THRESHOLD = 0.8
#: Words that a place may have beyond those of its template.
SLACK = 3


def spaced(text: Column) -> Column:
    """The words of a text, each with a space of its own on both sides."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def count_words(column: Column) -> Column:
    """Words of a ``spaced`` text, or of a part of it that ends between words."""
    return ((F.length(column) - F.length(F.replace(column, F.lit(" "), F.lit("")))) / 2).cast("long")


def phrases(phrase_labels: list[tuple[str, str]]) -> dict[str, Column]:
    """Places of phrases in the column ``spaced``: how many, the first and last, and the labels."""
    count, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in phrase_labels:
        words = re.split(" ", phrase)
        overlaps = any(words[:k] == words[-k:] for k in range(1, len(words)))
        pattern = " " + "  ".join(words) + " "
        s, found = F.col("spaced"), F.contains("spaced", F.lit(pattern))
        apart = ((F.length(s) - F.length(F.replace(s, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")
        # Places of a phrase that ends as it starts may share words; a look-ahead counts each of them.
        places = F.regexp_count(s, F.lit(f"(?={pattern})")) if overlaps else apart
        count += F.when(found, places).otherwise(0)
        firsts.append(F.when(found, count_words(F.substring_index(s, pattern, 1))))
        lasts.append(F.when(found, F.col("n_words") - count_words(F.substring_index(s, pattern, -1)) - len(words)))
        labels.append(F.when(found, F.lit(label)))
    least = lambda pick, xs: pick(*xs) if len(xs) > 1 else xs[0]
    return {"n_base": count, "first_word": least(F.least, firsts), "last_word": least(F.greatest, lasts),
            "found": F.array_compact(F.array(*labels))}


class Template(NamedTuple):
    """The different words of a template, how many are needed, how long a place of it is, and the words that must be there."""
    label: str
    words: list[str]
    need: int
    length: int
    must: list[str]


def prepared(templates: list[tuple[str, str]], threshold: float) -> list[Template]:
    """What the join needs to know; words by which a template differs from one that would meet its threshold are a must."""
    sets = [set(text.split()) for _, text in templates]
    enough = lambda n: max(1, math.ceil(threshold * n - 1e-9))
    out = []
    for (label, text), words in zip(templates, sets):
        near = [other for other in sets if other != words and len(words & other) >= enough(len(words))]
        out.append(Template(label, sorted(words), enough(len(words)), len(text.split()) + SLACK, sorted(set().union(*(words - other for other in near)))))
    return out


def lower_words(text: str = "text") -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD, " "), " "), lambda w: w != "")


def text_blocks(docs: DataFrame, vocabulary: list[str], rare: list[str], length: int, fewest: int) -> DataFrame:
    """``(doc, h, block, words)``: stretches of ``2 * length`` words, half overlapping, with their different words of ``vocabulary``.

    Only those with ``fewest`` of these words and one that is ``rare`` can be met.
    ``h`` is the hash of the whole text, which tells rows with one doc_id apart.
    """
    has_rare = lambda words: F.exists(words, lambda w: w.isin(rare))
    starts = lambda n: F.sequence(F.lit(1), F.greatest(n - length, F.lit(1)), F.lit(length))
    cut_up = lambda ws: F.when(has_rare(ws), F.filter(
        F.transform(starts(F.size(ws)), lambda at: F.struct(F.slice(ws, at, 2 * length).alias("block"))), lambda b: has_rare(b["block"])))
    blocks = F.element_at(F.transform(F.array(lower_words()), cut_up), 1)
    return (docs.select(id_key().alias("doc"), F.xxhash64("text").alias("h"), F.inline(blocks))
            .withColumn("words", F.array_distinct(F.filter("block", lambda w: w.isin(vocabulary)))).filter(F.size("words") >= fewest))


def block_templates(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc, h, label, score)`` for every block and template that is met in it; the score is the best share of its words at one place."""
    known = prepared(templates, threshold)
    vocabulary = sorted({w for t in known for w in t.words})
    fewest, longest = min(t.need for t in known), max(t.length for t in known)
    # One number for each word of the templates: how often it stands in all texts.
    held = {r["word"]: r["n"] for r in docs.select(F.explode(F.filter(lower_words(), lambda w: w.isin(vocabulary))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    first_words = lambda t: sorted(t.words, key=rank.get)[:len(t.words) - t.need + 1]
    blocks = text_blocks(docs, vocabulary, sorted({w for t in known for w in first_words(t)}), longest, fewest)
    kind = "word string, place int, label string, need int, length int, must array<string>, template array<string>"
    rows = [(w, i, t.label, t.need, t.length, t.must, t.words) for t in known for i, w in enumerate(first_words(t))]
    prefixes = docs.sparkSession.createDataFrame(rows, kind)
    ranks = F.create_map(*[x for w in order for x in (F.lit(w), F.lit(rank[w]))])
    ranked = blocks.withColumn("words", F.transform(F.sort_array(F.transform("words", lambda w: F.struct(ranks[w].alias("r"), w.alias("w")))), lambda x: x["w"]))
    heads = ranked.select("doc", "h", "block", "words", F.posexplode(F.slice("words", F.lit(1), F.size("words") - fewest + 1)).alias("at", "word"))
    n, t = F.size("words"), F.size("template")
    room = F.least("at", "place") + 1 + F.least(n - F.col("at") - 1, t - F.col("place") - 1)
    pairs = heads.join(prefixes, "word").filter((n >= F.col("need")) & (room >= F.col("need"))).filter(
        F.size(F.array_intersect("words", "template")) >= F.col("need"))
    # The best place begins with a word of the template.
    begins = F.filter(F.sequence(F.lit(1), F.size("block")), lambda at: F.array_contains("template", F.get("block", at - 1)))
    shared = lambda at: F.array_intersect("template", F.slice("block", at, F.col("length")))
    best = F.array_max(F.transform(begins, lambda at: F.when(F.size(F.array_except("must", shared(at))) == 0, F.size(shared(at))).otherwise(0)))
    return (pairs.withColumn("best", best).filter(F.col("best") >= F.col("need"))
            .select("doc", "h", "label", (F.col("best") / t.cast("double")).alias("score")))


def license_scan(docs: DataFrame, phrase_labels: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with the licenses named in it.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score``: places of the phrases, their labels, all labels, and the largest
    containment of a template at a place (0 if none is met). A null
    text counts as empty. Rows that repeat a doc_id are told apart by their text;
    other columns are not read; an empty table gives no rows.
    """
    met = (block_templates(docs, templates, threshold).groupBy("doc", "h")
           .agg(F.collect_set("label").alias("more"), F.max("score").alias("score")))
    rows = docs.select(id_key().alias("doc"), F.xxhash64("text").alias("h"), spaced(F.col("text")).alias("spaced"))
    rows = rows.withColumn("n_words", count_words(F.col("spaced")))
    rows = rows.select("doc", "h", "n_words", *[c.alias(name) for name, c in phrases(phrase_labels).items()])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.join(met, ["doc", "h"], "left").select(
        id_back(F.col("doc")).alias("doc_id"), "n_words", "n_base", "first_word", "last_word", joined(F.col("found")).alias("base_labels"),
        joined(F.concat("found", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _phrase_sql(phrase: str) -> str:
    words = phrase.split()
    tests = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words, 1))
    return f"list_filter(range(0, greatest(0, CAST(len(ws) AS BIGINT) - {len(words) - 1})), lambda i: {tests})"


def _lower_words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


OP5_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_lower_words_sql("text")} AS ws FROM d),
p AS (SELECT doc_id, text, len(ws) AS n_words, {", ".join(f"{_phrase_sql(ph)} AS p{i}" for i, (ph, _) in enumerate(PHRASES))} FROM w),
t(label, ws, span) AS (VALUES {", ".join(f"('{label}', {sorted(set(text.split()))}, {len(text.split()) + SLACK})" for label, text in TEMPLATES)}),
near AS (SELECT a.label, a.ws, list_filter(a.ws, lambda x: NOT list_contains(b.ws, x)) AS own FROM t a, t b
  WHERE a.ws <> b.ws AND len(list_intersect(a.ws, b.ws)) >= {THRESHOLD} * len(a.ws) - 1e-9),
must AS (SELECT t.label, t.ws, t.span, coalesce(list_distinct(flatten(list(own))), []) AS must FROM t LEFT JOIN near ON near.ws = t.ws GROUP BY t.label, t.ws, t.span),
spot AS (SELECT doc_id, label, must.ws AS tw, must, list_distinct(w.ws[i:i + span - 1]) AS bw
  FROM (SELECT doc_id, ws, unnest(range(1, CAST(len(ws) AS BIGINT) + 1)) AS i FROM w) w JOIN must ON list_contains(must.ws, w.ws[i])),
hit AS (SELECT doc_id, label, len(list_intersect(bw, tw)) / CAST(len(tw) AS DOUBLE) AS score FROM spot
  WHERE len(list_intersect(bw, tw)) >= {THRESHOLD} * len(tw) - 1e-9 AND len(list_intersect(bw, must)) = len(must)),
met AS (SELECT doc_id, list(DISTINCT label) AS more, max(score) AS score FROM hit GROUP BY doc_id),
f AS (SELECT *, list_concat(p0, p1, p2) AS spots, list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS found FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(spots) AS BIGINT) AS first_word,
  CAST(list_max(spots) AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(found)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(found, coalesce(more, [])))), ',') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM f LEFT JOIN met USING (doc_id)"""
