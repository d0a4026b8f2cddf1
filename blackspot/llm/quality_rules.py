"""Quality rules: a table of thresholds compiled into one projection.

A rule bounds the ratio of two measures of a text, in thousandths, so that both
sides of its comparison are whole numbers. ``compile_rules`` turns a list of rules
into one expression; ``measures`` makes the measures from the text with built-in
functions alone. There is no shuffle: a text is read once and judged on its own.

Values that are used several times (the words, the lines, the sorted windows) are
bound by ``let``; the optimizer would else compute them at every use.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blackspot.llm.common import documents

BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words in a window.
WINDOW = 8
#: Common short words of four languages, in lower case.
STOP_WORDS = """a al als an and are as au auf aus avec be by con da das de del der des die du ein eine el elle en es est et for from für gar
ha have he his i il in is ist it la las le les lo los mais mi mit nicht no not of on oder on para pas por pour qu que qui se sich sie sind sont
su sur that the this to un una und une von was with y zu""".split()


class Rule(NamedTuple):
    """``least <= 1000 * part / whole <= most``; a bound of None is open, and a whole of 0 passes."""
    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


RULES = [
    Rule("few_words", "n_words", "one", 20_000, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 300),
    Rule("word_length", "word_chars", "n_words", 2_000, 15_000),
    Rule("symbols", "n_symbols", "n_words", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 10, None),
    Rule("letters", "n_letter_words", "n_words", 700, None),
    Rule("capitals", "n_capitals", "word_chars", None, 500),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
]
#: The rules that the base verdict consists of.
BASE = ("few_words", "repeated_words")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def count(column: Column) -> Column:
    return F.size(column).cast("long")


def drop_chars(column: Column, chars: str) -> Column:
    return F.translate(column, chars, "")


def neighbours_equal(ordered: Column, field: str) -> Column:
    """The items of a sorted list of structs whose ``field`` equals that of the one before or after."""
    same = lambda x, other: F.coalesce(x[field] == other[field], F.lit(False))
    return F.filter(ordered, lambda x, k: same(x, F.get(ordered, k - 1)) | same(x, F.get(ordered, k + 1)))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that stand twice or more in the list.

    Every word is hashed once and a window by the hashes of its words. If all
    windows differ in hash, none is repeated. Else they are sorted by hash, and
    those that share one again by their words, so hashes decide nothing.
    """
    in_order = lambda hashes: F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), (k + 1).alias("at"))))
    by_words = lambda some: F.sort_array(F.transform(some, lambda x: F.struct(F.slice(words, x["at"], window).alias("g"), x["at"].alias("at"))))

    def covered(hashes: Column) -> Column:
        starts = let(in_order(hashes), lambda hashed: let(by_words(neighbours_equal(hashed, "h")), lambda exact: F.sort_array(
            F.transform(neighbours_equal(exact, "g"), lambda x: x["at"]))))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - at, F.lit(window)))), F.lit(0).cast("long"),
            lambda total, more: total + more))

    def of(word_hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - window)
        hashes = F.transform(places, lambda at: F.xxhash64(*[F.get(word_hashes, at + k) for k in range(window)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(words) <= window, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of)).cast("long")


def measures(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """A struct with every measure of a text; null counts as empty.

    ``n_lines`` counts lines with a word, ``n_cut_lines`` those that end in dots
    (``...`` or an ellipsis), ``n_capitals`` the letters A-Z.
    """
    text = F.coalesce(text, F.lit(""))
    ends = lambda line: F.rtrim(line, F.lit(BLANKS))

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            count(words).alias("n_words"),
            F.length(drop_chars(text, BLANKS)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(drop_chars(text, SYMBOLS))).cast("long").alias("n_symbols"),
            (count(lines) - count(F.array_distinct(lines))).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            count(F.filter(words, lambda w: F.lower(w).isin(stop_words))).alias("n_stop_words"),
            count(F.filter(words, lambda w: F.rlike(w, F.lit(r"\p{L}")))).alias("n_letter_words"),
            (F.length(text) - F.length(drop_chars(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_capitals"),
            count(lines).alias("n_lines"),
            count(F.filter(lines, lambda l: F.endswith(ends(l), F.lit("...")) | F.endswith(ends(l), F.lit("…")))).alias("n_cut_lines"))

    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(drop_chars(line, BLANKS)) > 0)
    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: let(lines, lambda l: of(words, l)))


def compile_rules(rules: list[Rule], of: Callable[[str], Column]) -> Column:
    """The names of the rules that a text breaks, in the order of the table; ``of`` gives a measure by its name."""
    def broken(rule: Rule) -> Column:
        part, whole = (F.lit(1) if name == "one" else of(name) for name in (rule.part, rule.whole))
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (part * 1000 < whole * rule.least)
        if rule.most is not None:
            bad = bad | (part * 1000 > whole * rule.most)
        return F.when(bad, F.lit(rule.name))
    return F.array_compact(F.array(*map(broken, rules))) if rules else F.array().cast("array<string>")


def quality(docs: DataFrame, rules: list[Rule] = RULES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``doc_id``, every measure, and ``broken``: the names of the rules that the text breaks.

    One row per row of ``docs``, in one projection. A null or empty text has zero
    in every measure; a ratio over zero passes, a bound on ``n_words`` itself does
    not. Repeated rows are judged alike; null ids stay null. Other columns are not
    read, so their names do not matter; an empty table gives no rows. A long text
    needs about 100 bytes of memory per word.
    """
    judged = let(measures(F.col("text"), stop_words), lambda m: F.struct(m.alias("m"), compile_rules(rules, lambda name: m[name]).alias("broken")))
    return docs.select("doc_id", judged.alias("judged")).select("doc_id", "judged.m.*", "judged.broken")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base_failed = F.arrays_overlap("broken", F.array(*map(F.lit, BASE)))
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.size("broken") == 0).alias("kept"))


OP12_SQL = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT r, s, array_to_string(ws[s:s + 7], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS s FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT s + d) AS n FROM rep, range(0, 8) g(d) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda v: lower(v) IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) AS n_stop_words,
  len(list_filter(ws, lambda v: regexp_matches(v, '\\p{{L}}'))) AS n_letter_words,
  length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_capitals,
  len(list_filter(ls, lambda l: regexp_matches(l, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z'))) AS n_cut_lines
  FROM w LEFT JOIN cov USING (r)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND 10 * n_symbols <= 3 * n_words
  AND 100 * n_stop_words >= n_words AND 10 * n_letter_words >= 7 * n_words AND 2 * n_capitals <= word_chars
  AND 2 * n_dup_lines <= n_lines AND 10 * n_cut_lines <= 3 * n_lines AS kept FROM j"""
