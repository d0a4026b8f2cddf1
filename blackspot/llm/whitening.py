"""Embedding whitening by a bidiagonal qd solver.

Vectors are read where they lie and never shuffled. One pass sums whole numbers,
so means are exact. One pass centres the rows and reduces them block by block to
one triangle R per task (QR of the triangle so far and the next block); triangles
are merged in a tree, so no task and not the driver holds more than two of them.
R has the singular values of all centred rows, and no product of a matrix with
itself is ever formed, which would halve the digits.

R (as wide as a vector, whatever the number of rows) is solved on its own:
Householder reflections make it bidiagonal, dqds finds the squares of its singular
values to high relative accuracy, and twisted factorisations of ``B'B = LDL'`` give
one direction for each. Two last passes project the rows: one measures how far the
covariance of the result is from the identity, one returns it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from blackspot.llm.repeats import record
from blackspot.runtime import cut

#: Components in the result; values in a block; triangles that one task of the tree merges.
COMPONENTS, BLOCK, FAN = 32, 1 << 18, 32
#: An entry becomes ``floor(SCALE * entry) + OFFSET``.
SCALE, OFFSET = 64, 1_000_000
#: Larger numbers could not be summed exactly.
LARGEST = 1 << 40
EPS = np.finfo(float).eps


class Whitening(NamedTuple):
    """``directions`` has a column per component; a component without variance has ``values`` 0 and gives 0."""
    n: int
    sums: np.ndarray
    values: np.ndarray
    trace: float
    directions: np.ndarray


def whole_numbers(b: pa.RecordBatch, width: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, x)`` for the complete vectors of a batch in blocks, those of ``width`` entries or of each width in turn."""
    column = b["embedding"]
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    start = np.append(0, np.cumsum(size))
    flat = column.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    wrong = np.append(0, np.cumsum(~np.isfinite(values)))
    good = (size > 0) & (wrong[start[1:]] == wrong[start[:-1]])
    for w in np.unique(size[good]).tolist() if width is None else [width]:
        rows = np.flatnonzero(good & (size == w))
        step = max(1, BLOCK // w)
        for at in range(0, len(rows), step):
            own = rows[at:at + step]
            x = np.floor(SCALE * values[start[own][:, None] + np.arange(w)])
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"entries of {LARGEST // SCALE} and more are not supported")
            yield own, x.astype(np.int64) + OFFSET


def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(width, place, n, s)``: sums over the vectors of a task, by their width."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for b in batches:
        for rows, x in whole_numbers(b, None):
            w = x.shape[1]
            sums[w] = sums.get(w, 0) + x.sum(0)
            counts[w] = counts.get(w, 0) + len(x)
    for w, s in sums.items():
        yield record("width place n s", np.full(w, w), np.arange(w), np.full(w, counts[w]), s)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S`` in whole numbers."""
    return n * x - sums


def joined(triangle: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of both."""
    d = triangle.shape[1]
    out = np.zeros((d, d))
    r = np.linalg.qr(np.concatenate([triangle, rows]), mode="r")
    out[:len(r)] = r
    return out


def reduce_rows(n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sums)
        r, some = np.zeros((d, d)), False
        for b in batches:
            for _, x in whole_numbers(b, d):
                r, some = joined(r, centred(x, n, sums) / n), True
        if some:
            yield record("r", pa.array([r.tobytes()], pa.binary()))
    return run


def merge(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, some = np.zeros((d, d)), False
        for b in batches:
            for held in b["r"]:
                r, some = joined(r, np.frombuffer(held.as_buffer(), float).reshape(d, d)), True
        if some:
            yield record("r", pa.array([r.tobytes()], pa.binary()))
    return run


def triangle(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of all centred rows; triangles meet ``FAN`` at a time."""
    parts = cut(vectors.mapInArrow(reduce_rows(n, sums), "r binary"))
    count = parts.count()
    while count > 1:
        count = -(-count // FAN)
        parts = cut(parts.repartition(count).mapInArrow(merge(len(sums)), "r binary"), replaces=parts)
        count = parts.count()
    return np.frombuffer(parts.first()["r"], float).reshape(len(sums), -1)


def reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection takes ``x`` to its first axis; zero if it lies there, or is nothing beside 1."""
    size = np.abs(x).max()
    if not np.any(x[1:]) or size < EPS ** 4:
        return np.zeros_like(x)
    v = x / size
    v[0] += np.copysign(np.linalg.norm(v), x[0])
    return v / np.linalg.norm(v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, upper diagonal, and the reflectors from the right."""
    a, d, right = r.copy(), len(r), []
    for k in range(d):
        v = reflector(a[k:, k])
        a[k:, k:] -= np.outer(2 * v, v @ a[k:, k:])
        if k < d - 2:
            w = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ w, 2 * w)
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds(q: list[float], e: list[float], tolerance: float = 1e-30, most: int = 1_000_000) -> list[float]:
    """Eigenvalues of ``B'B`` from the squares of the two diagonals of B.

    A step replaces B by another bidiagonal matrix with all values less by a
    shift. The reciprocals of the ``d`` of a step without shift sum to those of the
    values, so one over their sum is a safe shift from below. Where an ``e``
    vanishes, the matrix falls into two.
    """
    out, todo, steps = [], [(q, e, 0.0)], 0
    while todo:
        q, e, moved = todo.pop()
        while len(q) > 1:
            steps += 1
            if steps > most:
                raise ArithmeticError("dqds does not converge")
            split = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tolerance * (moved + q[i + 1]) or e[i] == 0), None)
            if split is not None:
                todo.append((q[:split + 1], e[:split], moved))
                q, e = q[split + 1:], e[split + 1:]
                continue
            d, back = q[0], 0.0
            for i in range(len(e)):
                back += 1 / d if d > 0 else np.inf
                d = d * (q[i + 1] / (d + e[i]))
            back += 1 / d if d > 0 else np.inf
            shift = 1 / back
            while True:
                new_q, new_e, d = [], [], q[0] - shift
                for i in range(len(e)):
                    if d < 0:
                        break
                    whole = d + e[i]
                    t = q[i + 1] / whole
                    new_q.append(whole), new_e.append(e[i] * t)
                    d = d * t - shift
                if d >= 0 or shift == 0:
                    break
                shift = shift * 0.9 if shift > EPS * moved else 0.0  # rounding took it beyond the least value
            q, e, moved = [*new_q, max(d, 0.0)], new_e, moved + shift
        out.append(q[0] + moved)
    return out


def twisted(d: np.ndarray, l: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A direction for each eigenvalue of ``LDL'``: factorisations from both ends meet where the middle is least."""
    size, m = len(d), len(values)
    safe = lambda x: np.where(x == 0, EPS * EPS * (d.max() or 1.0), x)
    down, up, s, p = (np.zeros((size, m)) for _ in range(4))
    s[0], p[-1] = -values, d[-1] - values
    for i in range(size - 1):
        plus = safe(s[i] + d[i])
        down[i] = d[i] * l[i] / plus
        s[i + 1] = down[i] * l[i] * s[i] - values
    for i in range(size - 2, -1, -1):
        minus = safe(d[i] * l[i] ** 2 + p[i + 1])
        t = d[i] / minus
        up[i] = l[i] * t
        p[i] = p[i + 1] * t - values
    middle = np.abs(s + p + values).argmin(0)
    z = np.zeros((size, m))
    z[middle, np.arange(m)] = 1
    for i in range(size - 2, -1, -1):
        z[i] = np.where(i < middle, -down[i] * z[i + 1], z[i])
    for i in range(size - 1):
        z[i + 1] = np.where(i >= middle, -up[i] * z[i], z[i + 1])
    return z / np.linalg.norm(z, axis=0)


def close_together(values: np.ndarray, gap: float) -> Iterator[tuple[int, int]]:
    """Runs of falling values that differ by less than ``gap`` of themselves."""
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i - 1] - values[i] > gap * values[i - 1]:
            if i - start > 1:
                yield start, i
            start = i


def block_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors of ``B'B`` for one B without zeros, in the order of its falling ``values``.

    Directions of values that are close are made orthogonal to one another; where
    that leaves little, inverse iteration finds what they span, and its own axes.
    """
    z = twisted(a * a, b / a[:-1], values)
    for start, end in close_together(values, 1e-3):
        group, r = np.linalg.qr(z[:, start:end])
        if np.abs(np.diag(r)).min() < 0.5:
            t = np.diag(a * a + np.append(0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
            group = np.random.default_rng(0).standard_normal(group.shape)
            for _ in range(3):
                group = np.linalg.qr(np.linalg.solve(t - np.eye(len(t)) * values[start:end].mean() * (1 + 8 * EPS), group))[0]
            group = group @ np.linalg.eigh(group.T @ t @ group)[1][:, ::-1]
        z[:, start:end] = group
    return z


def singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of ``r``, falling, and the right singular vectors as columns."""
    scale = np.abs(r).max() if r.size else 0.0
    if not scale:
        return np.zeros(len(r)), np.eye(len(r))
    a, b, right = bidiagonal(r / scale)
    norm = max(np.abs(a).max(), np.abs(b).max(initial=0))
    a = np.where(np.abs(a) < EPS * EPS * norm, EPS * EPS * norm, a)
    b[np.abs(b) < EPS * EPS * norm] = 0
    values, vectors, edges = [], [], [0, *(np.flatnonzero(b == 0) + 1).tolist(), len(a)]
    for lo, hi in zip(edges, edges[1:]):
        own = np.sort(dqds((a[lo:hi] ** 2).tolist(), (b[lo:hi - 1] ** 2).tolist()))[::-1]
        z = np.zeros((len(a), hi - lo))
        z[lo:hi] = block_vectors(a[lo:hi], b[lo:hi - 1], own)
        values.append(own), vectors.append(z)
    values, z = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-values, kind="stable")
    values, z = values[order], z[:, order]
    for k in range(len(right) - 1, -1, -1):
        w = right[k]
        z[k + 1:] -= np.outer(2 * w, w @ z[k + 1:])
    return values * scale ** 2, z


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all complete vectors, or None without any.

    ``embeddings`` has ``vec_id, embedding``. Vectors that are null, empty, shorter
    than the longest or hold a null or non-finite entry are left out. The signs of
    directions make their largest entry positive.
    """
    vectors = embeddings.select("embedding")
    sums = cut(vectors.mapInArrow(total, "width long, place long, n long, s long").groupBy("width", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    rows = sums.filter(F.col("width") == sums.agg(F.max("width")).scalar()).orderBy("place").collect()
    if not rows:
        return None
    n, s = rows[0]["n"], np.array([r["s"] for r in rows])
    values, z = singular(triangle(vectors, n, s))
    values = np.where(values > (16 * len(s) * EPS) ** 2 * values.max(initial=0), values, 0.0) / n
    z = z * np.sign(z[np.abs(z).argmax(0), np.arange(len(s))])
    return Whitening(n, s, values[:components], float(values.sum()), z[:, :components])


def projected(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    """From rows ``n * x - S`` to whitened ones."""
    scaled = np.where(model.values > 0, model.directions / np.sqrt(np.where(model.values > 0, model.values, 1)), 0)
    return lambda rows: rows / model.n @ scaled


def products(model: Whitening):
    """Sums of products of whitened entries, and of the entries (``j`` is -1), over a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, k = projected(model), len(model.values)
        both = np.zeros((k, k + 1))
        for b in batches:
            for _, x in whole_numbers(b, len(model.sums)):
                w = project(centred(x, model.n, model.sums))
                both += np.concatenate([w.sum(0)[:, None], w.T @ w], axis=1)
        i, j = np.divmod(np.arange(k * (k + 1)), k + 1)
        yield record("i j s", i, j - 1, both.ravel())
    return run


def identity_error(embeddings: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened covariance minus the identity, over components with variance; 0 without any."""
    k = len(model.values)
    both = np.zeros((k, k + 1))
    for r in embeddings.select("embedding").mapInArrow(products(model), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        both[r["i"], r["j"] + 1] = r["s"] / model.n
    mean, covariance = both[:, 0], both[:, 1:]
    some = model.values > 0
    return float(np.abs(covariance - np.outer(mean, mean) - np.eye(k))[np.ix_(some, some)].max(initial=0))


def whiten(embeddings: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` for every complete vector: an exact decimal, and an array with an entry per component.

    ``deviation`` is the sum over dimensions of ``(n * x - S) ** 2``. A component
    without variance gives 0. Null ids stay null and repeated rows are rows of
    their own; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = projected(model)
        for b in batches:
            for rows, x in whole_numbers(b, len(model.sums)):
                off = centred(x, model.n, model.sums)
                # Squares and their sum stay below 2**63, or Python's whole numbers take over.
                small = float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2.0 ** 62
                deviation = (off * off).sum(1) if small else (off.astype(object) ** 2).sum(1)
                w = project(off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield record("vec_id deviation whitened", b["vec_id"].take(pa.array(rows)), pa.array([str(v) for v in deviation.tolist()]), lists)

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return (embeddings.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>")
            .withColumn("deviation", F.col("deviation").cast("decimal(38,0)")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null here; ``whiten`` has it."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(embeddings)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.lit([float(v) / model.trace if model.trace else 0.0 for v in model.values])
    return (whiten(embeddings, model).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(identity_error(embeddings, model)).alias("identity_error")))
