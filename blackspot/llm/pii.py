"""Personal data: exact patterns, and candidates judged by gradient-boosted trees.

Four patterns give the base spans, which always stay. Looser generators propose
further, overlapping spans of the same kinds: addresses written around an at
sign, and groups of digits with any separators, whole or in part. One more
generator proposes a kind of its own, secrets: long values that are assigned to a
name, as in ``token = "..."``. Boosted trees score a candidate by its format and its surroundings. They learn in a bounded
sample of documents, whose base spans are rewritten into forms that no base
pattern accepts: the plus sign goes, separators change, an at sign is written
out. What is learned from is what may be added, candidates that touch no base
span of the rewritten text; true are the rewritten spans. Other data of these
kinds that no pattern accepts counts as false there, which makes the trees add
less, not more. For secrets an assignment is put into each document of the sample:
true are random values of a name for secrets; values made of the document's own
words, and random values of other names such as checksums, are false. What the
documents themselves assign to a name for secrets is not learned from. Scores are
calibrated on documents that were not trained on, and a kind adds spans only from
the score at which its precision there, shrunk to that of all kinds, is high enough.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from blackspot.llm.common import documents, id_back, id_key, in_parts, stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = KINDS.index("secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, so the look-behind only saves time on long runs.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators: what may be an address, and groups of digits with separators between them.
AT = re.compile(r"\s?(?:@|\[at\]|\(at\))\s?")
NAME_BEFORE, NAME_AFTER = re.compile(r"[^\s@]{1,64}\Z"), re.compile(r"[^\s@]{1,255}")
GROUPS = re.compile(r"[+(]?[0-9](?:[\x20().,/:-]{0,2}[0-9])+")
LEAST_DIGITS, MOST_DIGITS = 6, 24
#: A long value behind a sign of assignment, and the name before the sign.
LEAST_VALUE = 12
VALUE = re.compile(r"(?:=>|:=|[=:])\s{0,2}[\"'`]?([A-Za-z0-9_+/=.~-]{12,})")
NAMED = re.compile(r"([A-Za-z0-9_.-]+)[\"'`]?\s{0,2}\Z")
#: What a name for secrets holds; whole names of either sort, signs and quotes to learn from.
SECRET_WORDS = ("token", "secret", "passw", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private")
SECRET_NAMES = ("token", "access_token", "secret", "client_secret", "password", "passwd", "pwd", "api_key", "apikey", "API-Key", "AWS_SECRET_ACCESS_KEY",
                "auth", "Authorization", "bearer", "credentials", "private_key")
OTHER_NAMES = ("sha", "sha1", "md5", "hash", "checksum", "commit", "digest", "etag", "id", "uuid", "version", "name", "path", "file", "http", "title", "url", "ref")
SIGNS, QUOTES = (" = ", "=", ": ", ":", " => ", " := "), ('"', '"', "'", "")
#: Forms of base spans to learn from: what stands for the at sign, a dot of an IP, and between groups of digits.
AT_FORMS = ("[at]", "(at)", " [at] ", " (at) ", " @ ")
DOT_FORMS = (". ", " .", " . ")
CARD_FORMS = (".", "/", ":", ", ", "  ")
PHONE_FORMS = (None, None, " ", "-", ".", "/", "")
HINTS = ("mail", "tel", "phone", "call", "fax", "ip", "host", "server", "card", "visa", "pay", "account", "id", "=", '"', ":")

#: Documents to learn from, trees, their depth, and the precision that an added kind must reach.
SAMPLE_DOCUMENTS, TREES, DEPTH, RATE = 20_000, 40, 3, 0.2
#: Most candidates to learn from.
MOST_CANDIDATES = 400_000
#: The precision of a kind is shrunk as if so many of its candidates had the one of all kinds.
BINS, PRECISION, SHRINK = 32, 0.98, 20

SPAN = "struct<kind:int,s:int,e:int,base:boolean>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping addresses: from each at sign to both sides, which stays linear on long words."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Accepted spans by kind; a match that fails its check is dropped."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return [emails(text),
            [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))],
            [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits(m)) <= 19 and luhn(d)],
            [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposed ``(kind, start, end)``, overlapping, each once."""
    out = set()
    if "@" in text or "at" in text:
        for m in AT.finditer(text):
            before, after = NAME_BEFORE.search(text, max(0, m.start() - 64), m.start()), NAME_AFTER.match(text, m.end())
            if before and after:
                end = after.end()
                while end > m.end() and not text[end - 1].isalnum():
                    end -= 1
                start = before.start()
                while start < m.start() and not text[start].isalnum():
                    start += 1
                if start < m.start() and end > m.end():
                    out.add((0, start, end))
    for m in GROUPS.finditer(text):
        whole, n = m[0], sum(c.isdigit() for c in m[0])
        spans = [m.span()]
        # Parts between spaces of a longer group, and the group without its opening sign.
        if " " in whole:
            spans += [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^\x20]+", whole)]
        if whole[0] in "+(":
            spans.append((m.start() + 1, m.end()))
        for s, e in spans:
            n = sum(c.isdigit() for c in text[s:e])
            if LEAST_DIGITS <= n <= MOST_DIGITS or text.count(".", s, e) == 3:
                out.update((kind, s, e) for kind in (1, 2, 3) if kind != 1 or text.count(".", s, e) >= 2)
    for m in VALUE.finditer(text):
        own = m[1].rstrip(".")
        if named(text, m.start(1)) and len(own) >= LEAST_VALUE:
            out.add((SECRET, m.start(1), m.start(1) + len(own)))
    return sorted(out)


def named(text: str, s: int) -> str:
    """The name that the value at ``s`` is assigned to, in lower case; empty if there is none."""
    m = NAMED.search(text[max(0, s - 64):s].rstrip("\"'`").rstrip().rstrip("=:>").rstrip())
    return m[1].lower() if m else ""


def secret_name(name: str) -> bool:
    return any(w in name for w in SECRET_WORDS) or name == "key"


def char_class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in "\"'`" else 5


def features(text: str, kind: int, s: int, e: int) -> list[float]:
    """Format of a candidate and what stands around it.

    Signs that only tell whether a base pattern accepts it are left out: no plus
    and no at sign.
    """
    own = text[s:e]
    groups = [len(g) for g in re.findall("[0-9]+", own)] or [0]
    before, after = text[max(0, s - 16):s].lower(), text[e:e + 8]
    value = value_features(own, named(text, s)) if kind == SECRET else [0.0] * VALUE_FEATURES
    return [kind, e - s, sum(c.isdigit() for c in own), sum(c.isalpha() for c in own), *[own.count(c) for c in " -.():/,"],
            len(groups), max(groups), min(groups), groups[0], groups[-1], len(set(own)), own[-1:].isdigit(),
            char_class(text[s - 1:s] if s else ""), char_class(after[:1]), char_class(text[s - 2:s - 1] if s > 1 else ""),
            char_class(after[1:2]), *[h in before for h in HINTS], *value]


#: How many :func:`value_features` gives.
VALUE_FEATURES = 9


def value_features(own: str, name: str) -> list[float]:
    """What tells a random value from words: classes of signs and how they mix, and what its name says."""
    counts = Counter(own)
    share = np.array(list(counts.values())) / len(own)
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "-" for c in own)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    letters = [len(r) for r in re.findall("[a-z]+|[A-Z]+", own)] or [0]
    return [secret_name(name), float(-(share * np.log2(share)).sum()), len(set(kinds)), changes / len(own), max(letters), max(counts.values()) / len(own),
            sum(c in "aeiouAEIOU" for c in own) / len(own), kinds.count("-"), not re.search("[^0-9A-Fa-f]", own)]


class Trees:
    """Gradient-boosted trees with logistic loss on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.bin(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self.apply(tree, b)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each inner node (bins up to it go left), and the value of each leaf."""
        feature, cut = np.zeros((1 << DEPTH) - 1, int), np.full((1 << DEPTH) - 1, BINS)
        node = np.zeros(len(g), int)
        for level in range(DEPTH):
            for k in range(1 << level):
                own = node == k
                best, at = 1e-6, (1 << level) - 1 + k
                total, weight = g[own].sum(), h[own].sum()
                for j in range(b.shape[1]):
                    left = np.cumsum(np.bincount(b[own, j], g[own], BINS + 1))[:-1]
                    mass = np.cumsum(np.bincount(b[own, j], h[own], BINS + 1))[:-1]
                    gain = left**2 / (mass + 1) + (total - left)**2 / (weight - mass + 1) - total**2 / (weight + 1)
                    if gain.max() > best:
                        best, feature[at], cut[at] = gain.max(), j, gain.argmax()
            at = (1 << level) - 1 + node
            node = 2 * node + (b[np.arange(len(g)), feature[at]] > cut[at])
        value = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
        return feature, cut, value

    @staticmethod
    def apply(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        for level in range(DEPTH):
            at = (1 << level) - 1 + node
            node = 2 * node + (b[np.arange(len(b)), feature[at]] > cut[at])
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bin(x)
        return self.start + sum(self.apply(t, b) for t in self.trees)


class Judge:
    """Trees with a threshold for each kind; ``None`` trees add nothing."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        learn = fold != 0
        self.trees, self.least = None, [np.inf] * len(KINDS)
        if not y[learn].any() or y[learn].all():
            return
        self.trees = Trees(x[learn], y[learn].astype(float))
        score = self.trees.score(x[~learn]) if (~learn).any() else np.zeros(0)
        y, kinds = y[~learn], x[~learn][:, 0]
        # Precision of all kinds above a score, itself shrunk to a half by one candidate.
        down = np.sort(score)[::-1]
        hits = np.cumsum(y[np.argsort(-score, kind="stable")])
        for kind in range(len(KINDS)):
            own = kinds == kind
            order = np.argsort(-score[own], kind="stable")
            s, hit, n = score[own][order], np.cumsum(y[own][order]), np.arange(1, own.sum() + 1)
            last = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)  # equal scores go together
            every = np.searchsorted(-down, -s, "right")
            pooled = (hits[every - 1] + 0.5) / (every + 1) if len(s) else s
            good = np.flatnonzero(last & (hit > 0) & ((hit + SHRINK * pooled) / (n + SHRINK) >= PRECISION))
            if len(good):
                # Half way to the next score of the kind, or to the next false candidate of any.
                at = good[-1]
                below = s[at + 1:at + 2] if at + 1 < len(s) else np.sort(score[~y & (score < s[at])])[-1:]
                self.least[kind] = float((s[at] + below[0]) / 2) if len(below) else float(s[at])

    def add(self, text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
        """Candidates above the threshold of their kind that touch no base span or better candidate."""
        if self.trees is None or min(self.least) == np.inf:
            return []
        found = [c for c in free(text, base) if self.least[c[0]] < np.inf]
        if not found:
            return []
        score = self.trees.score(np.array([features(text, *c) for c in found], float))
        out = []
        for i in np.argsort(-score, kind="stable").tolist():
            kind, s, e = found[i]
            if score[i] >= self.least[kind] and not any(a < e and s < b for _, a, b in out):
                out.append((kind, s, e))
        return out


def rewritten(kind: int, own: str) -> str:
    """A base span in a form that its pattern does not accept; which one depends on its text alone."""
    pick = lambda forms: forms[zlib.crc32(own.encode()) % len(forms)]
    if kind == 0:
        return pick(AT_FORMS).join(own.rsplit("@", 1))
    if kind == 1:
        return own.replace(".", pick(DOT_FORMS))
    digits = re.sub("[^0-9]", "", own)
    if kind == 2:
        return pick(CARD_FORMS).join(re.findall("[0-9]{1,4}", digits))
    # A phone keeps its groups, with its own separators or others, or has none.
    bare = own[1:]
    form = pick(PHONE_FORMS)
    return bare if form is None else form.join(re.findall("[0-9]+", bare))


def examples(text: str) -> list[tuple[int, int, int, bool, str]]:
    """Candidates to learn from: ``(kind, start, end, true, text)``, places being those of the rewritten text.

    Base spans that overlap another are left as they are.
    """
    spans = sorted((s, e, kind) for kind, own in enumerate(base_spans(text)) for s, e in own)
    parts, true, last, size, reach = [], set(), 0, 0, 0
    for i, (s, e, kind) in enumerate(spans):
        alone = reach <= s and (i + 1 == len(spans) or e <= spans[i + 1][0])
        reach = max(reach, e)
        if not alone:
            continue
        new = rewritten(kind, text[s:e])
        parts += [text[last:s], new]
        size += s - last + len(new)
        true.add((kind, size - len(new), size))
        last = e
    new, planted = with_value("".join([*parts, text[last:]]), true)
    known = lambda kind, s: kind != SECRET or s == planted or not secret_name(named(new, s))
    return [(*c, c in true, new) for c in free(new, base_spans(new)) if known(*c[:2])]


def with_value(text: str, true: set[tuple[int, int, int]]) -> tuple[str, int]:
    """``text`` with an assigned value put between two words, and the place of the value.

    Which one, and where, depends on the text alone. ``true`` spans behind it move
    along, and the value joins them if it is a secret.
    """
    seed = hashlib.sha256(text.encode(errors="replace")).digest()
    pick = lambda forms, i: forms[seed[i] % len(forms)]
    at = text.find(" ", int.from_bytes(seed[:6]) % (len(text) + 1))
    if at < 0 or any(s < at < e for _, s, e in true):
        at = len(text)
    sort = seed[6] % 5  # two secrets, a checksum, and two values of words
    key = hashlib.sha256(seed).digest()
    random = (key.hex(), key[:20].hex(), key[:16].hex().upper(), base64.b64encode(key[:24]).decode(), base64.urlsafe_b64encode(key[:15]).decode(),
              key[:20].hex().upper(), re.sub("[^A-Za-z0-9]", "", base64.b64encode(key).decode())[:22])
    words = re.findall("[A-Za-z]{2,16}", text[max(0, at - 60):at + 60])[:2 + seed[7] % 4] or ["x" * 8]
    while len(words) < 16 and sum(map(len, words)) < LEAST_VALUE:
        words.append(words[len(words) // 2])
    value = pick(random, 8) if sort < 3 else pick(("_", "-", ".", "/", ""), 9).join(words)
    name = pick(SECRET_NAMES if sort < 2 or sort == 3 else OTHER_NAMES, 10)
    name = name.upper() if value.isupper() and seed[11] % 2 else name
    quote = pick(QUOTES, 12)
    head = " " + name + pick(SIGNS, 13) + quote
    place, size = at + len(head), len(head) + len(value) + len(quote)
    moved = {(kind, s + size * (s >= at), e + size * (s >= at)) for kind, s, e in true}
    true.clear()
    true.update(moved, [(SECRET, place, place + len(value))] if sort < 2 else [])
    return text[:at] + head + value + quote + text[at:], place


def free(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """Candidates that touch no base span."""
    starts, ends = [], []
    for s, e in sorted(span for spans in base for span in spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    # The first stretch that ends after the candidate's start must not begin before its end.
    return [c for c in candidates(text) if (i := bisect_right(ends, c[1])) == len(ends) or starts[i] >= c[2]]


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, most: int = MOST_CANDIDATES) -> Judge:
    """Trees from the candidates of about ``sample`` documents, drawn by a hash of doc_id.

    If these have more than ``most`` candidates, ``most`` of them are drawn by a
    hash of document and place, which knows neither the fold nor the label: folds
    and labels keep their shares.
    """
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    mark = F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1_000_000))
    picked = docs.select(mark.alias("mark"), F.coalesce("text", F.lit("")).alias("text")).filter(mark < F.lit(int(share * 1_000_000) + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(examples(text)) for text in b["text"].to_pylist())], pa.int64())], names=["n"])
    found = picked.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    # A little more than the share that is needed; the least hashes are taken below.
    bound = int(min(1.0, 1.1 * most / max(found, 1)) * (1 << 63))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            rows = []
            for mark, text in zip(b["mark"].to_pylist(), b["text"].to_pylist()):
                for kind, s, e, true, new in examples(text):
                    h = xxhash.xxh64_intdigest(f"{mark} {kind} {s} {e}") >> 1
                    if h <= bound:
                        rows.append((h, mark % 3, true, [float(v) for v in features(new, kind, s, e)]))
            h, fold, y, x = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(fold, pa.int32()), pa.array(y, pa.bool_()),
                                              pa.array(x, pa.list_(pa.float64()))], names=["h", "fold", "y", "x"])
    # An order of their own, so that the trees do not depend on the partitions.
    rows = picked.mapInArrow(run, "h long, fold int, y boolean, x array<double>").orderBy("h", "fold", "y", "x").limit(most).toPandas()
    if not len(rows):
        return Judge(np.zeros((0, 1)), np.zeros(0, bool), np.zeros(0, int))
    return Judge(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(bool), rows["fold"].to_numpy())


def private_spans(docs: DataFrame, judge: Judge) -> DataFrame:
    """``(doc, spans)`` for every row of ``docs``: kind, start and end (code points, end exclusive) and whether base.

    Base spans of one kind do not overlap, those of different kinds may. A null
    text counts as empty. Other columns are not read; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("base", pa.bool_())]))
        for b in in_parts(batches):
            out = []
            for text in b["text"].to_pylist():
                base = base_spans(text)
                spans = [(k, s, e, True) for k, own in enumerate(base) for s, e in own]
                spans += [(k, s, e, False) for k, s, e in judge.add(text, base)]
                out.append([dict(zip(("kind", "s", "e", "base"), x)) for x in sorted(spans)])
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(out, kinds)], names=["doc", "spans"])
    return docs.select(id_key().alias("doc"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc long, spans array<{SPAN}>")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, all spans, and how many of them are secrets."""
    docs = documents(spark, sf_dir)
    found = private_spans(docs, fit(docs))
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    base = F.filter("spans", lambda x: x["base"])
    # A second parameter of the function would be the index.
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    secrets = F.size(F.filter("spans", lambda x: x["kind"] == SECRET)).cast("long")
    return stored(found.select(id_back(F.col("doc")).alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                               joined(F.col("spans")).alias("spans"), secrets.alias("n_secret"), F.size("spans").cast("long").alias("n_spans")))
