"""Language ID by a linear-chain conditional random field over words.

Every word gets a label, so code-switched text is labelled word by word; the
language of a document is the label with the largest mean posterior. Features of a
word are the word itself (lexicon), its first and last one to three bytes
(affixes), and its byte pairs and triples (n-grams), hashed into tables of fixed
size. Transitions between labels are learned; posteriors come from
forward-backward over all chains of a slab at a time.

The model is trained here, by stochastic gradient on the likelihood, on at most
``SAMPLE`` documents of each language of no more than ``SAMPLE_BYTES`` bytes;
where a language has fewer of these, also on runs of words of its longer ones.
Their words are cut into spans and spliced into chains across documents, so that
changes of language occur in training.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from blackspot.llm.arrays import BYTES, mix, range_hash, spread, sums, words
from blackspot.llm.common import documents, id_back, id_key, in_parts, stored
from blackspot.llm.repeats import each_slab, record
from blackspot.llm.simhash import LOWER

#: Training documents of a language, and the most bytes of one; of longer texts a run of words is taken.
SAMPLE, SAMPLE_BYTES = 200, 20_000
#: Words in a chain: a document is labelled in pieces of so many words.
CHAIN = 128
AFFIXES = 3
BITS, GRAM_BITS = 17, 16
EPOCHS, BATCH_CHAINS, RATE, SHRINK, SEED = 4, 64, 0.3, 1e-6, 7
UNDEFINED = "und"


class Features:
    """Indices into the feature tables for the words of a slab."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        self.starts, self.ends, self.first = words(data, offsets)
        s, e = self.starts, self.ends
        total = sums(data.astype(np.uint64) + np.uint64(1), BYTES)
        ranges = [(s, e)]
        for k in range(1, AFFIXES + 1):
            ranges += [(s, np.minimum(s + k, e)), (np.maximum(e - k, s), e)]
        mask = np.uint64((1 << BITS) - 1)
        self.hashed = [(mix(range_hash(total, a, b, BYTES) + np.uint64(i)) & mask).astype(np.int32) for i, (a, b) in enumerate(ranges)]
        # N-grams of the bytes of words, in the order of words.
        size = e - s
        wide = data.astype(np.uint32)
        self.grams = []
        for n in (2, 3):
            owner, rank = spread(np.maximum(size - n + 1, 0))
            at = s[owner] + rank
            code = wide[at]
            for k in range(1, n):
                code = code * np.uint32(257) + wide[at + k]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
            self.grams.append((code.astype(np.int32), owner, np.append(0, np.cumsum(np.maximum(size - n + 1, 0)))))


class Model:
    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.hashed = np.zeros((1 << BITS, n), np.float32)
        self.grams = [np.zeros((1 << GRAM_BITS, n), np.float32) for _ in (2, 3)]
        self.transition = np.zeros((n, n), np.float32)

    def emissions(self, f: Features) -> np.ndarray:
        out = np.zeros((len(f.starts), len(self.labels)))
        for index in f.hashed:
            out += self.hashed[index]
        for (code, _, cut), table in zip(f.grams, self.grams):
            total = np.zeros((len(code) + 1, out.shape[1]))
            np.cumsum(table[code], axis=0, dtype=np.float64, out=total[1:])
            out += total[cut[1:]] - total[cut[:-1]]
        return out


def posteriors(scores: np.ndarray, order: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the words and summed posteriors of the transitions, by forward-backward.

    Chain ``i`` is the next ``lengths[i]`` of the words ``order``; chains of one
    slab are stepped through together, the longest first.
    """
    n = scores.shape[1]
    begin = np.cumsum(lengths) - lengths
    by = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[by], lengths[by]
    local = np.exp(scores[order] - scores[order].max(axis=1, keepdims=True))
    move = np.exp(transition - transition.max()).astype(np.float64)
    ahead, behind = np.zeros((len(order), n)), np.ones((len(order), n))
    steps = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(steps), "left")  # chains longer than t
    pairs = np.zeros((n, n))
    for t in range(steps):
        at = begin[:live[t]] + t
        a = local[at] if t == 0 else (ahead[at - 1] @ move) * local[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = begin[:live[t + 1]] + t
        after = local[at + 1] * behind[at + 1]
        b = after @ move.T
        behind[at] = b / b.sum(axis=1, keepdims=True)
        weight = ahead[at] / (ahead[at] * b).sum(axis=1, keepdims=True)
        pairs += weight.T @ after * move
    both = ahead * behind
    out = np.empty_like(scores)
    out[order] = both / both.sum(axis=1, keepdims=True)
    return out, pairs


def chains(first: np.ndarray) -> np.ndarray:
    """Lengths of the chains of all documents of a slab."""
    counts = np.diff(first)
    parts = -(-counts // CHAIN)
    owner, rank = spread(parts)
    return np.minimum(counts[owner] - rank * CHAIN, CHAIN)


def train(texts: list[bytes], langs: list[str]) -> Model:
    """A model of the languages in ``langs``, one label for each text."""
    model = Model(sorted(set(langs)))
    if not texts:
        return model
    rng = np.random.default_rng(SEED)
    sizes = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    f = Features(np.frombuffer(b"".join(texts), np.uint8), sizes)
    label = np.repeat(np.array([model.labels.index(x) for x in langs]), np.diff(f.first))
    n = len(label)
    tables = [model.hashed, *model.grams, model.transition]
    squares = [np.full(t.shape, 1e-6, np.float32) for t in tables]
    # Spans of words, in an order that changes from epoch to epoch.
    cuts = np.unique(np.append(f.first[:-1], np.flatnonzero(rng.random(n) < 1 / 24)))
    spans = np.split(np.arange(n), cuts[cuts > 0])
    for _ in range(EPOCHS):
        rng.shuffle(spans)
        flow = np.concatenate(spans)
        for low in range(0, n, CHAIN * BATCH_CHAINS):
            order = flow[low:low + CHAIN * BATCH_CHAINS]
            lengths = np.minimum(len(order) - np.arange(0, len(order), CHAIN), CHAIN)
            scores, position = subset(model, f, order)
            got, pairs = posteriors(scores, np.arange(len(order)), lengths, model.transition)
            y = label[order]
            error = -got
            error[np.arange(len(order)), y] += 1
            truth = np.zeros_like(model.transition)
            inner = np.flatnonzero((np.arange(len(order)) + 1) % CHAIN)[:-1] if len(order) > 1 else np.zeros(0, int)
            inner = inner[inner + 1 < len(order)]
            np.add.at(truth, (y[inner], y[inner + 1]), 1)
            grads = [scatter([x[order] for x in f.hashed], [error] * len(f.hashed), 1 << BITS)]
            for code, owner, cut in position:
                grads.append(scatter([code], [error[owner]], 1 << GRAM_BITS))
            grads.append(truth - pairs)
            for table, square, grad in zip(tables, squares, grads):
                grad = grad / len(order) - SHRINK * table
                square += (grad * grad).astype(np.float32)
                table += (RATE * grad / np.sqrt(square)).astype(np.float32)
    return model


def subset(model: Model, f: Features, order: np.ndarray) -> tuple[np.ndarray, list]:
    """Scores of some words, and their n-grams."""
    scores = np.zeros((len(order), len(model.labels)))
    for index in f.hashed:
        scores += model.hashed[index[order]]
    grams = []
    for (code, _, cut), table in zip(f.grams, model.grams):
        owner, rank = spread(cut[order + 1] - cut[order])
        own = code[cut[order][owner] + rank]
        for k in range(scores.shape[1]):
            scores[:, k] += np.bincount(owner, weights=table[own, k], minlength=len(order))
        grams.append((own, owner, None))
    return scores, grams


def scatter(indices: list[np.ndarray], errors: list[np.ndarray], size: int) -> np.ndarray:
    index, error = np.concatenate(indices), np.concatenate(errors)
    return np.stack([np.bincount(index, weights=error[:, k], minlength=size) for k in range(error.shape[1])], axis=1)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def some_words(text: Column, most_bytes: int) -> Column:
    """A run of whole words of a long text, chosen by a hash of doc_id, of about ``most_bytes`` bytes."""
    length = F.floor(F.length(text) * F.lit(float(most_bytes)) / F.octet_length(text)).cast("int")
    start = F.pmod(F.xxhash64("doc_id", F.lit("run")), F.length(text) - length + 1).cast("int") + 1
    run = F.substring(text, start, length)
    # Words at the ends may be cut; a run without a space is one word.
    whole = F.regexp_replace(F.regexp_replace(run, r"^\S*\s", ""), r"\s\S*$", "")
    return F.when(whole.rlike(r"\S"), whole).otherwise(run)


def learnable(docs: DataFrame, may_learn: Column, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(lang, _r, text)``: at most ``sample`` texts of each language in those rows of ``docs`` that may be learned from.

    They are drawn by a hash of doc_id: a first cut by the share that is needed,
    then the rows of least hash. Texts of more than ``most_bytes`` bytes are taken
    where a language has too few shorter ones, and then only a run of their words.
    """
    ready = (docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
             .select("lang", "text", "doc_id", (F.octet_length("text") > most_bytes).alias("_long"), F.xxhash64("doc_id", F.lit("sample")).alias("_h")))
    counts = ready.groupBy("lang").agg(F.count_if(~F.col("_long")).alias("short"), F.count_if("_long").alias("long")).collect()
    chance = F.lit(False)
    for r in counts:
        for long, n, need in ((False, r["short"], sample), (True, r["long"], sample - r["short"])):
            if n and need > 0:
                share = min(1.0, 2 * need / n)
                chance = chance | ((F.col("lang") == r["lang"]) & (F.col("_long") == long)
                                   & (F.pmod(F.col("_h"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)))
    text = F.when(F.col("_long"), some_words(F.col("text"), most_bytes)).otherwise(F.col("text"))
    best = Window.partitionBy("lang").orderBy("_long", "_h", "text")
    return (ready.filter(chance).select("lang", "_long", "_h", text.alias("text")).withColumn("_r", F.row_number().over(best))
            .filter(F.col("_r") <= sample).select("lang", "_r", "text"))


def fit(docs: DataFrame, may_learn: Column, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the languages of those rows of ``docs`` that may be learned from, trained on ``learnable`` texts."""
    rows = learnable(docs, may_learn, sample, most_bytes)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((x["lang"], x["_r"], x["text"]) for b in batches for x in b.to_pylist())
        model = train([text.encode() for _, _, text in found], [lang for lang, _, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
    # The sample is bounded, so one task can hold it.
    trained = rows.repartition(1).mapInArrow(learn, "model binary").head(1)
    return pickle.loads(trained[0]["model"]) if trained else Model([])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc, h, out, lang, score, sure)`` for every row of ``docs``: its language and the mean posterior of it.

    ``sure`` is the mean over words of the largest posterior: how certain the
    labels of the words are, whether they agree or not. A null text and one without
    a letter get ``und`` and 0. Other columns than doc_id and text are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.labels, UNDEFINED], object)
        for b in in_parts(batches):
            for part, data, offsets in each_slab(b):
                f = Features(data, offsets)
                n = len(part)
                mean, sure = np.zeros((n, max(1, len(model.labels)))), np.zeros(n)
                if len(f.starts) and model.labels:
                    word, _ = posteriors(model.emissions(f), np.arange(len(f.starts)), chains(f.first), model.transition)
                    doc = np.repeat(np.arange(n), np.diff(f.first))
                    for k in range(len(model.labels)):
                        mean[:, k] = np.bincount(doc, weights=word[:, k], minlength=n)
                    mean /= np.maximum(np.diff(f.first), 1)[:, None]
                    sure = np.bincount(doc, weights=word.max(axis=1), minlength=n) / np.maximum(np.diff(f.first), 1)
                best = mean.argmax(axis=1)
                known = part["lettered"].to_numpy(zero_copy_only=False) & bool(model.labels) & (np.diff(f.first) > 0)
                yield record("doc h out lang score sure", part["doc"], part["h"], part["out"],
                             pa.array(names[np.where(known, best, len(model.labels))], pa.string()),
                             np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0), np.where(known, np.clip(sure, 0, 1), 0.0))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(id_key().alias("doc"), F.xxhash64("text").alias("h"), held_out().alias("out"), lettered.alias("lettered"), "text")
    return rows.mapInArrow(run, "doc long, h long, out boolean, lang string, score double, sure double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose words have known languages, with all their columns.

    A row goes if it is ``und``, or if the largest posterior of its words is below
    ``least`` on average. Text in several languages stays if its words are certain.
    """
    gone = (identify(docs, model).filter((F.col("lang") == UNDEFINED) | (F.col("sure") < least))
            .select(F.col("doc").alias("_gone"), F.col("h").alias("_h")).distinct())
    return docs.join(stored(gone), (id_key() == F.col("_gone")) & (F.xxhash64("text") == F.col("_h")), "left_anti")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs, ~held_out()))
    return stored(found.select(id_back(F.col("doc")).alias("doc_id"), F.col("out").alias("held_out"), F.col("lang").alias("lang_pred"), "score"))
