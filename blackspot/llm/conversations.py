"""Conversation structure repair: dynamic programming over a grammar shared by all conversations.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.
The cheapest edits (keep, rerole, delete, insert) come from a finite automaton
with four states. A row turns into one of nine symbols (its initial and whether it
is cut off, or "must go"), and a symbol into a min-plus matrix: for every pair of
states the cheapest cost of the edits that lead from one to the other, and the
least string of edit initials (the audit) with that cost.

1. Rows of a conversation that are equal are counted, not kept; rows with the role
   and text of an earlier one are found by the least turn of each class.
2. Rows are sorted by range, so one conversation may lie in many tasks, and cut
   into pieces of at most ``PIECE`` symbols. Equal pieces of all conversations are
   reduced to one.
3. Re-Pair: rounds replace the most frequent pairs of symbols in the different
   pieces by new ones, as many pairs a round as do not overlap. Every rule gets one
   matrix, the product of its two parts, made once, bottom up. Its audits are
   ropes: a rule keeps only the state between its parts, and its text is made
   when it is needed.
4. The matrix of a piece is the product of its few symbols; it goes back to all
   conversations with that piece. A last pass in the order of the rows multiplies
   the pieces of each conversation and writes the repaired rows as they come by.

Two audits for the same rows and states are never a proper prefix of one another,
since each has one letter other than ``I`` for every row and ends in one. So the
least string of a whole is made of least strings of its parts, and the matrix
product is exact with its ties.

A conversation of any length is held as its audit and one row; SHA-256 is a chain,
so its repaired text passes one task in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from blackspot.joins import HEAVY, split_join
from blackspot.llm.common import MISSING, id_back, id_key, in_parts
from blackspot.llm.repeats import list_rows, record
from blackspot.runtime import cut, forget

#: Symbols of a piece; pairs replaced in a round; rounds.
PIECE, PAIRS, ROUNDS = 1024, 128, 10
#: Symbols: small letters are the initials of roles (``o`` any other), capitals the same of rows that are cut off, ``-`` must go.
SYMBOLS = b"suaoSUAO-"
KEEP, CUT_OFF, REROLE, DELETE, INSERT = 0, 3, 3, 4, 3
#: States of the automaton: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a state takes next, when the repair may choose.
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEVER = 1 << 60

PIECES = """conv long, no long, rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long,
 first_role int, last_role int, first_turn long, last_turn long, symbols binary"""


def inserts(state: int) -> Iterator[tuple[int, int]]:
    """States reached by insertions alone, and how many; going round again never pays."""
    seen, count = {}, 0
    while state not in seen:
        seen[state] = count
        yield state, count
        state, count = STEPS[state, NEXT[state][0]], count + 1


def terminal(symbol: str) -> tuple[np.ndarray, list[list[bytes]]]:
    """Costs and audits of one row after any insertions before it, from state to state."""
    cost, audit = np.full((4, 4), NEVER), [[b""] * 4 for _ in range(4)]

    def offer(i: int, j: int, c: int, letters: bytes) -> None:
        if (c, letters) < (int(cost[i, j]), audit[i][j] if cost[i, j] < NEVER else b"~"):
            cost[i, j], audit[i][j] = c, letters

    for i in range(4):
        for state, n in inserts(i):
            before, paid = b"I" * n, INSERT * n
            offer(i, state, paid + DELETE, before + b"D")
            if symbol == "-":
                continue
            more = CUT_OFF if symbol.isupper() else 0
            offer(i, STEPS[state, NEXT[state][0]], paid + REROLE + more, before + b"R")
            kept = STEPS.get((state, symbol.lower()))
            if kept is not None:
                offer(i, kept, paid + KEEP + more, before + b"K")
    return cost, audit


def product(a: np.ndarray, b: np.ndarray, text) -> tuple[np.ndarray, np.ndarray]:
    """Min-plus product and the state between; ``text(i, k, j)`` settles ties."""
    total = a[:, :, None] + b[None, :, :]
    cost, between = np.minimum(total.min(1), NEVER), total.argmin(1)
    for i, j in np.argwhere(((total == cost[:, None, :]).sum(1) > 1) & (cost < NEVER)):
        between[i, j] = min(np.flatnonzero(total[i, :, j] == cost[i, j]).tolist(), key=lambda k: text(i, k, j))
    return cost, between


class Grammar:
    """Rules with one matrix each. Symbols below ``len(SYMBOLS)`` are terminals, the rest are pairs of earlier symbols."""

    def __init__(self):
        self.pairs: list[tuple[int, int]] = []
        self.cost, self.between, self.letters = [], [], []
        for s in SYMBOLS.decode():
            cost, audit = terminal(s)
            self.cost.append(cost), self.letters.append(audit)

    def audit(self, symbol: int, i: int, j: int) -> bytes:
        """The text of a rope; the states between the parts say where it goes."""
        out, todo, base = [], [(symbol, i, j)], len(SYMBOLS)
        while todo:
            s, i, j = todo.pop()
            if s < base:
                out.append(self.letters[s][i][j])
            else:
                (left, right), k = self.pairs[s - base], self.between[s - base][i, j]
                todo += [(right, k, j), (left, i, k)]
        return b"".join(out)

    def add(self, left: int, right: int) -> int:
        cost, between = product(self.cost[left], self.cost[right], lambda i, k, j: self.audit(left, i, k) + self.audit(right, k, j))
        self.pairs.append((left, right)), self.cost.append(cost), self.between.append(between)
        return len(self.cost) - 1

    def matrix(self, sequence: list[int], audit) -> tuple[np.ndarray, list[list[bytes]]]:
        """The product of a sequence, with the audits as text."""
        cost = self.cost[sequence[0]]
        texts = [[audit(sequence[0], i, j) if cost[i, j] < NEVER else b"" for j in range(4)] for i in range(4)]
        for s in sequence[1:]:
            after, between = product(cost, self.cost[s], lambda i, k, j: texts[i][k] + audit(s, k, j))
            texts = [[texts[i][between[i, j]] + audit(s, between[i, j], j) if after[i, j] < NEVER else b"" for j in range(4)] for i in range(4)]
            cost = after
        return cost, texts


def facts(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation with their number; ``later`` rows stood, with role and text, at an earlier turn.

    ``rows`` is the output of ``cleaned``.
    """
    kinds = cut(rows.groupBy("conv", "turn", "role", "h").agg(F.count(F.lit(1)).alias("n"), F.any_value("blank").alias("blank"),
                                                              F.any_value("cut_off").alias("cut_off")))
    again = classes(kinds).filter("turns > 1").select("conv", "role", "h", "first", "size")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return cut(split_join(kinds, again, ["conv", "role", "h"], "size", "turn", "left")
               .select("conv", "turn", "role", "h", "n", "blank", "cut_off", code.alias("initial"),
                       F.coalesce(F.col("turn") > F.col("first"), F.lit(False)).alias("later")), replaces=kinds)


def classes(kinds: DataFrame) -> DataFrame:
    return kinds.groupBy("conv", "role", "h").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("turns"), F.sum("n").alias("size"))


def cleaned(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` without nulls, a hash of the text, and the faults that a row shows on its own."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select(id_key("conv_id").alias("conv"), id_key("turn").alias("turn"), space("role"), space("text"))
    return rows.select("*", F.unhex(F.sha2("text", 256)).alias("h"), (~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"),
                       (~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))).alias("cut_off"))


def expanded(b: pa.RecordBatch, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, first)`` of every copy that the counts of a batch stand for, about ``most`` of them at a time."""
    n = b["n"].to_numpy()
    end = np.cumsum(n)
    at = 0
    total = int(end[-1]) if len(end) else 0
    while at < total:
        place = np.arange(at, min(at + most, total))
        row = np.searchsorted(end, place, "right")
        yield row, place == end[row] - n[row]
        at += most


def pieces(size: int):
    """Pieces of conversations in the order of their rows, with what the report counts in them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 40
        for b in batches:
            conv, turn, initial = (b[c].to_numpy(zero_copy_only=False) for c in ("conv", "turn", "initial"))
            blank, cut_off, later = (b[c].to_numpy(zero_copy_only=False) for c in ("blank", "cut_off", "later"))
            for row, first in expanded(b):
                new_conv = np.append(True, conv[row[1:]] != conv[row[:-1]])
                heads = np.flatnonzero(new_conv)
                within = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
                head = np.flatnonzero(within % size == 0)
                end = np.append(head[1:], len(row))
                inner = np.ones(len(row), bool)
                inner[head] = False
                gone = blank[row]
                copy = ~gone & (later[row] | ~first)
                short = ~gone & ~copy & cut_off[row]
                who, when = initial[row], turn[row]
                before, last = np.append(-1, who[:-1]), np.append(MISSING, when[:-1])
                legal = ((who == 1) & ((before == 0) | (before == 2))) | ((who == 2) & (before == 1))
                timed = when != MISSING
                symbol = np.where(gone | copy, len(SYMBOLS) - 1, who + 4 * short).astype(np.uint8)
                text = symbol.tobytes()
                add = lambda x: np.add.reduceat(x.astype(np.int64), head)
                # Turns are sorted and nulls come first: the least known turn is where the last of them is not known.
                low = np.where(timed, when, np.iinfo(np.int64).max)
                yield record("conv no rows blank duplicate truncated illegal turns low high first_role last_role first_turn last_turn symbols",
                             conv[row[head]], no + np.arange(len(head)), end - head, add(gone), add(copy), add(short), add(inner & ~legal),
                             add(timed & (~inner | (when != last))), np.minimum.reduceat(low, head), np.maximum.reduceat(when, head),
                             who[head].astype(np.int32), who[end - 1].astype(np.int32), when[head], when[end - 1],
                             pa.array([text[i:j] for i, j in zip(head.tolist(), end.tolist())], pa.binary()))
                no += len(head)
    return run


def pair_codes(flat: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Codes of neighbouring symbols; -1 where the next one belongs to another sequence."""
    code = flat[:-1].astype(np.int64) << 32 | flat[1:]
    return np.where(row[1:] == row[:-1], code, -1)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat, row = list_rows(b["seq"])
        if len(flat) > 1:
            code, n = np.unique(pair_codes(flat.to_numpy(), row), return_counts=True)
            yield record("pair n", code[code >= 0], n[code >= 0])


def replace_pairs(codes: np.ndarray, symbols: np.ndarray):
    """Sequences with every chosen pair replaced, from the left; ``codes`` are sorted and do not overlap but with themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, row = list_rows(b["seq"])
            flat = flat.to_numpy()
            found = pair_codes(flat, row) if len(flat) else np.zeros(0, np.int64)
            which = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            hit = codes[which] == found
            # Hits next to each other are of one symbol and itself: every second of them counts.
            at = np.flatnonzero(hit)
            run_start = np.flatnonzero(np.append(True, np.diff(at) > 1)) if len(at) else at
            rank = np.arange(len(at)) - np.repeat(run_start, np.diff(np.append(run_start, len(at))))
            at = at[rank % 2 == 0]
            out, keep = flat.copy(), np.ones(len(flat), bool)
            out[at], keep[at + 1] = symbols[which[at]], False
            ends = np.append(0, np.cumsum(np.bincount(row[keep], minlength=len(b)))).astype(np.int32)
            yield record("symbols same seq", b["symbols"], b["same"], pa.ListArray.from_arrays(pa.array(ends), pa.array(out[keep])))
    return run


def to_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = [len(x) for x in b["symbols"].to_pylist()]
        flat = np.frombuffer(b"".join(b["symbols"].to_pylist()), np.uint8).astype(np.int32)
        yield record("symbols same seq", b["symbols"], b["same"],
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat)))


def re_pair(different: DataFrame, pairs: int = PAIRS, rounds: int = ROUNDS) -> tuple[Grammar, DataFrame]:
    """A grammar for ``(symbols, same)``, and the table with the sequences ``seq`` over it.

    A round counts all pairs of neighbours in all sequences and replaces up to
    ``pairs`` of those that occur twice, the most frequent first. A pair that
    could overlap one chosen before waits for the next round. At most ``pairs *
    rounds`` rules come about; they go to every task.
    """
    schema = "symbols binary, same long, seq array<int>"
    grammar, sequences = Grammar(), cut(different.select("symbols", "same").mapInArrow(to_sequences, schema))
    for _ in range(rounds):
        frequent = (sequences.select("seq").mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
                    .filter("n > 1").orderBy(F.desc("n"), "pair").limit(2 * pairs).collect())
        firsts, seconds, chosen = set(), set(), {}
        for r in frequent:
            left, right = r["pair"] >> 32, r["pair"] & 0xFFFFFFFF
            if len(chosen) < pairs and right not in firsts and left not in seconds:
                firsts.add(left), seconds.add(right)
                chosen[r["pair"]] = grammar.add(left, right)
        if not chosen:
            break
        codes = np.array(sorted(chosen))
        sequences = cut(sequences.mapInArrow(replace_pairs(codes, np.array([chosen[c] for c in codes.tolist()], np.int32)), schema), replaces=sequences)
    return grammar, sequences


def matrices(grammar: Grammar):
    """The matrix of every sequence: costs and audits from state to state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit = lru_cache(1 << 14)(grammar.audit)
        for b in batches:
            solved = [grammar.matrix(seq, audit) for seq in b["seq"].to_pylist()]
            yield record("symbols same cost audit", b["symbols"], b["same"],
                         pa.array([c.ravel().tolist() for c, _ in solved], pa.list_(pa.int64())),
                         pa.array([[x for line in t for x in line] for _, t in solved], pa.list_(pa.binary())))
    return run


class Rope:
    """Audits of the pieces so far; ropes of one conversation share their beginnings."""
    __slots__ = ("before", "text")

    def __init__(self, before: Rope | None, text: bytes):
        self.before, self.text = before, text

    def since(self, other: Rope) -> tuple[bytes, bytes]:
        """The texts of both after their common beginning; they have as many pieces."""
        mine, its, a, b = [], [], self, other
        while a is not b:
            mine.append(a.text), its.append(b.text)
            a, b = a.before, b.before
        return b"".join(reversed(mine)), b"".join(reversed(its))

    def whole(self) -> bytes:
        texts, at = [], self
        while at is not None:
            texts.append(at.text)
            at = at.before
        return b"".join(reversed(texts))


class Repair:
    """One conversation as its pieces and rows come by in order."""

    def __init__(self, conv: int):
        self.conv = conv
        self.states: list[tuple[int, Rope | None]] = [(0, None), (NEVER, None), (NEVER, None), (NEVER, None)]
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low, self.high, self.role, self.turn = None, None, None, MISSING
        self.audit, self.at, self.state, self.place, self.text = None, 0, START, 0, None

    def piece(self, p: dict) -> None:
        for name in self.counts:
            self.counts[name] += p[name]
        if self.role is not None:
            self.counts["illegal"] += (self.role, p["first_role"]) not in ((0, 1), (1, 2), (2, 1))
            self.counts["turns"] -= self.turn == p["first_turn"] != MISSING
        self.role, self.turn = p["last_role"], p["last_turn"]
        if p["high"] != MISSING:
            self.low, self.high = p["low"] if self.low is None else self.low, p["high"]
        after: list[tuple[int, Rope | None]] = []
        for j in range(4):
            best = NEVER, None
            for i, (paid, rope) in enumerate(self.states):
                cost = paid + p["cost"][4 * i + j]
                if cost < NEVER and cost <= best[0]:
                    own = Rope(rope, p["audit"][4 * i + j])
                    if cost == best[0]:
                        mine, its = own.since(best[1])
                    if cost < best[0] or mine < its:
                        best = cost, own
            after.append(best)
        self.states = after

    def plan(self) -> tuple[int, bytes]:
        """The cheapest whole audit: the end is well formed before the first row or after an assistant row."""
        if self.audit is None:
            ends = []
            for state, (cost, rope) in enumerate(self.states):
                more = 0 if state == START else dict(inserts(state))[ASSISTANT]
                if cost < NEVER:
                    ends.append((cost + INSERT * more, (rope.whole() if rope else b"") + b"I" * more))
            self.cost, self.audit = min(ends)
        return self.cost, self.audit

    def step(self, role: str) -> None:
        self.state = STEPS[self.state, role[:1]]
        self.place += 1

    def insertions(self) -> Iterator[tuple[str, str, str]]:
        _, audit = self.plan()
        while audit[self.at:self.at + 1] == b"I":
            self.at += 1
            role = NEXT[self.state]
            self.step(role)
            yield "I", role, ""

    def rows(self, role: str, n: int) -> Iterator[tuple[str, str, str]]:
        """What becomes of ``n`` equal rows whose text came just before them."""
        for _ in range(n):
            yield from self.insertions()
            letter = self.plan()[1][self.at:self.at + 1].decode()
            self.at += 1
            if letter != "D":
                role = NEXT[self.state] if letter == "R" else role
                self.step(role)
                yield letter, role, self.text
        self.text = None

    def report(self) -> dict:
        c, known = self.counts, self.low is not None
        cost, audit = self.plan()
        return {"conv": self.conv, "gaps": self.high - self.low + 1 - c["turns"] if known else 0, "blank": c["blank"],
                "duplicate": c["duplicate"], "truncated": c["truncated"], "illegal": c["illegal"], "cost": cost, "audit": audit.decode()}


#: Kinds of rows in the last pass, in the order in which they come for a conversation.
KNOWN, PART, TEXT = range(3)
REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv long, place long, role string, text string, edit string"


def arrow_type(name: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string()}[name]


def repairing(whole_rows: bool):
    """The last pass: repaired rows, or one report for each conversation with the hash of its repaired text."""
    columns = [c.split() for c in (ROWS if whole_rows else REPORT).split(", ")]
    schema = pa.schema([(name, arrow_type(kind)) for name, kind in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out, held = None, None, [], 0

        def take(edits):
            nonlocal held
            for letter, role, text in edits:
                if whole_rows:
                    out.append({"conv": now.conv, "place": now.place - 1, "role": role, "text": text, "edit": letter})
                    held += len(text)
                else:
                    digest.update(f"{chr(10) if now.place > 1 else ''}{role}:{text}".encode())

        def finish():
            take(now.insertions())
            if not whole_rows:
                out.append(now.report() | {"repaired_sha256": digest.hexdigest()})

        for b in in_parts(batches):
            names = b.schema.names
            for values in zip(*(c.to_pylist() for c in b.columns)):
                row = dict(zip(names, values))
                if now is None or row["conv"] != now.conv:
                    if now is not None:
                        finish()
                    now, digest = Repair(row["conv"]), hashlib.sha256()
                if row["kind"] == PART:
                    now.piece(row)
                elif row["kind"] == TEXT and row["text"] is not None:
                    now.text = row["text"]
                elif row["kind"] == TEXT:
                    take(now.rows(row["role"], row["rows"]))
                if held > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if now is not None:
            finish()
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def planned(conversations: DataFrame, known: DataFrame | None, size: int, pairs: int, rounds: int) -> DataFrame:
    """The input of the last pass, in its order: pieces with their matrices, then each row's text and its number of copies."""
    rows = cleaned(conversations)
    kinds = facts(rows)
    order = ["conv", "turn", "role", "h"]
    parts = cut(kinds.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "n", "blank", "cut_off", "initial", "later")
                .mapInArrow(pieces(size), PIECES))
    grammar, sequences = re_pair(parts.groupBy("symbols").agg(F.count(F.lit(1)).alias("same")), pairs, rounds)
    solved = cut(sequences.mapInArrow(matrices(grammar), "symbols binary, same long, cost array<long>, audit array<binary>"))
    forget(sequences)
    parts = split_join(parts, solved, ["symbols"], "same", "conv").drop("symbols", "same").withColumns(
        {"kind": F.lit(PART), "at": F.col("no")}).drop("no")
    # A text that a thousandth of all rows have in one conversation travels once; there are fewer than a thousand of those.
    total = kinds.agg(F.sum("n")).scalar()
    hot = F.broadcast(classes(kinds).filter(F.col("size") * HEAVY > total).select("conv", "role", "h"))
    texts = rows.filter("not blank").select("conv", "turn", "role", "h", "text")
    key = ["conv", "role", "h"]
    texts = texts.join(hot, key, "left_anti").unionByName(
        texts.join(hot, key, "left_semi").groupBy(key).agg(F.min("turn").alias("turn"), F.any_value("text").alias("text")))
    stream = (texts.select("conv", F.lit(TEXT).alias("kind"), F.col("turn").alias("at"), "role", "h", F.lit(0).alias("sub"), "text")
              .unionByName(kinds.select("conv", F.lit(TEXT).alias("kind"), F.col("turn").alias("at"), "role", "h", F.lit(1).alias("sub"),
                                        F.col("n").alias("rows")), allowMissingColumns=True)
              .unionByName(parts, allowMissingColumns=True))
    if known is not None:
        stream = stream.unionByName(known.select(id_key("conv_id").alias("conv"), F.lit(KNOWN).alias("kind")).distinct(), allowMissingColumns=True)
    return stream.repartition("conv").sortWithinPartitions("conv", "kind", "at", "role", "h", "sub").drop("at", "h", "sub")


def repaired(conversations: DataFrame, size: int = PIECE, pairs: int = PAIRS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of every conversation after the cheapest repair: ``conv_id, place, role, text, edit``.

    ``place`` counts from 0, ``edit`` is ``K``, ``R`` or ``I``. For what counts
    as what see ``repair_report``.
    """
    out = planned(conversations, None, size, pairs, rounds).mapInArrow(repairing(True), ROWS)
    return out.select(id_back(F.col("conv")).alias("conv_id"), "place", "role", "text", "edit")


def repair_report(conversations: DataFrame, known: DataFrame | None = None, size: int = PIECE, pairs: int = PAIRS,
                  rounds: int = ROUNDS) -> DataFrame:
    """One row per conversation: its gaps, faults, cheapest edits and the hash of its repaired rows.

    ``conversations`` has ``conv_id, turn, role, text``. Rows go by turn, null
    turns first; rows of one turn by role, then by SHA-256 of the text. A null role
    or text counts as one space, rows with a null conv_id are one conversation.
    The first fault of a row counts: blank, duplicate (role and text stood earlier),
    truncated (does not end in ``.!?``). Keeping a row costs 0, another role 3,
    deleting it 4 (blank and duplicate rows must go), an inserted empty row 3, and a
    truncated row that stays 3 more. Of the cheapest ways the one whose letters are
    least is taken. Conversations of ``known`` (``conv_id``) without rows are
    reported with zeros and an empty audit. Other columns are not read; repeated
    rows are copies of a row; an empty table gives no rows.
    """
    out = planned(conversations, known, size, pairs, rounds).mapInArrow(repairing(False), REPORT)
    return out.select(id_back(F.col("conv")).alias("conv_id"), *[F.col(c.split()[0]) for c in REPORT.split(", ")[1:]])


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of ``conv_id:turn``; nulls become one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault, text = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20, space("text")
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"),
                                F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                                F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return cut(repair_report(damaged(conversations), conversations.select("conv_id")))


def _repair_sql() -> str:
    """The same dynamic program, row by row, in recursive SQL; a state is its cost, audit and repaired text."""
    def more(v: str, cost: str, letter: str, row: str | None) -> str:
        text = f"{v}.o" if row is None else f"{v}.o || CASE WHEN {v}.o = '' THEN '' ELSE chr(10) END || {row}"
        return f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 'o': {text}}}"

    least = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    when = lambda test, option: f"CASE WHEN {test} THEN {option} ELSE {{'c': 1000000000, 'a': '~', 'o': ''}} END"
    user, reply = ([more(v, "3", "I", f"'{role}:'") for v in states] for role, states in (("user", ("v0", "vs", "va")), ("assistant", ("vu",))))
    twice = [more(f"({more(v, '3', 'I', chr(39) + 'user:' + chr(39))})", "3", "I", "'assistant:'") for v in ("v0", "vs")]
    closed = f"{least('vu', *user)} AS iu, {least('va', *reply, *twice)} AS ia"
    to = lambda states, role, initial: [x for v in states for x in (
        when("keep", more(v, "3 + m", "R", f"'{role}:' || text")), when(f"keep AND initial = '{initial}'", more(v, "m", "K", "role || ':' || text")))]
    step = (f"{more('v0', '4', 'D', None)} AS v0, {least(more('vs', '4', 'D', None), to(['v0'], 'system', 's')[1])} AS vs, "
            f"{least(more('iu', '4', 'D', None), *to(['v0', 'vs', 'ia'], 'user', 'u'))} AS vu, "
            f"{least(more('ia', '4', 'D', None), *to(['iu'], 'assistant', 'a'))} AS va")
    return f"""WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i))),
src AS (SELECT coalesce(conv_id, -9223372036854775808) AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT * EXCLUDE (k, t), xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) % 20 AS f FROM src, tab),
dam AS (SELECT conv, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS z FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, substr(role, 1, 1) AS initial,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) || substr(role, 1, 1) AS pair FROM pos),
fact AS (SELECT *, CASE WHEN z = '' THEN 'b' WHEN again THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault FROM seen),
step AS (SELECT conv, i, role, text, initial, fault IN ('t', 'k') AS keep, CASE fault WHEN 't' THEN 3 ELSE 0 END AS m FROM fact),
walk AS (SELECT conv, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS v0, {{'c': CAST(1000000000 AS BIGINT), 'a': '~', 'o': ''}} AS vs,
  {{'c': CAST(1000000000 AS BIGINT), 'a': '~', 'o': ''}} AS vu, {{'c': CAST(1000000000 AS BIGINT), 'a': '~', 'o': ''}} AS va FROM src GROUP BY conv
  UNION ALL SELECT conv, i, {step} FROM (SELECT w.conv, s.i, role, text, initial, keep, m, v0, vs, {closed} FROM walk w JOIN step s ON s.conv = w.conv AND s.i = w.i + 1)),
last AS (SELECT conv, {least('v0', 'ia')} AS v FROM (SELECT *, {closed} FROM (SELECT conv, max_by(v0, i) AS v0, max_by(vs, i) AS vs, max_by(vu, i) AS vu, max_by(va, i) AS va
  FROM walk GROUP BY conv))),
told AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM fact GROUP BY conv)
SELECT CASE WHEN conv > -9223372036854775808 THEN conv END AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, v.c AS cost, v.a AS audit,
  sha256(v.o) AS repaired_sha256 FROM last LEFT JOIN told USING (conv)"""


OP13_SQL = _repair_sql()
