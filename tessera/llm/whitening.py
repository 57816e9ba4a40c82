"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The rows of the table, centred and divided by sqrt(n), are a tall matrix X
whose covariance is XᵀX.  Each step makes one pass over the rows that gives
both products at once: the left vector u = Xq and the next right direction
Xᵀu.  A left vector is as long as the table and is never held: it is kept as
its coefficients p (u = Xp), and the inner product of any Xq with it is
(Xᵀu)·q, known from the pass that made it.  Both sides are reorthogonalised
in full, twice, before a vector is used.  The singular value decomposition of
the small bidiagonal matrix gives the components (right singular vectors) and
the deviations along them (singular values).

A run ends when the wanted triplets have converged or the space is used up.
As a run finds one vector of several with equal deviations, a further run
starts from a new direction at right angles to all that was found, until none
of its deviations beats the least one wanted; the result therefore holds
repeated deviations too.

Per pass a task sends d + 1 numbers, added up by Spark; the driver holds
vectors of d entries only.  Sums over the entries are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

SCALE, SHIFT = 1024, 100_000
# entries beyond this have no exact integer form and count as not finite
MAX_ENTRY = float(1 << 40)
LONG_MAX = (1 << 63) - 1
# a check run takes this many steps at least before it finds nothing larger
CHECK_STEPS = 12


@dataclass
class Whitening:
    """``components`` (rows, falling ``eigenvalues``), row count and the exact
    per-dimension ``sums`` of the integer vectors, trace of the covariance."""
    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray
    passes: int = 0


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x): x = floor(1024 c) + 100000 of every entry c as double.

    Left out: null vectors, vectors with a null, infinite, NaN or huge entry
    (absolute value above 2^40), empty vectors, and vectors whose length is
    not the commonest one (of equally common lengths the largest)."""
    ok = F.forall(vec_col, lambda c: F.coalesce(F.abs(c.cast("double")) <= MAX_ENTRY, F.lit(False)))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col)).filter(
        F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ok)
    x = F.transform(vec_col, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    rows = materialise(rows.select("id", x.alias("x")), "whitening-vectors")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == common["d"]) if common else rows


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in Python integers where 64 bits could overflow."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) > LONG_MAX:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * np.int64(n) - np.array(sums, dtype=np.int64)


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all rows of the vector (``size`` numbers) that ``part`` makes
    of the matrix of a batch; one vector leaves each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(_matrix(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    got = rows.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["i"]] = r["v"]
    return out


def _exact_sums(rows: DataFrame, d: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            if b.num_rows:
                total = [a + int(s) for a, s in zip(total, _matrix(b.column(0)).sum(axis=0, dtype=object))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array(map(str, total), pa.string())],
                                         names=["i", "v"])

    got = rows.select("x").mapInArrow(run, "i long, v string").groupBy("i").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    sums = [0] * d
    for r in got:
        sums[r["i"]] = int(r["v"])
    return sums


def _orthogonal(v: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for a in against:
            v = v - (a @ v) * a
    return v


def bidiagonalise(product, d: int, wanted: int, locked: list[np.ndarray], seed: int, tolerance: float,
                  least: float = -1.0):
    """One run from a random direction at right angles to ``locked``.

    ``product(q)`` gives (|Xq|², XᵀXq).  Returns (singular values, right
    vectors as rows, passes, whether the rest of the space is used up).  The
    run ends when the first ``wanted`` vectors have errors (residual over
    distance to the next value) below ``tolerance``; past half of the space it
    goes on to the end, which costs less than a check run.  A check run also
    ends when its largest value, with the whole residual, stays below ``least``."""
    room = d - len(locked)
    v = _orthogonal(np.random.default_rng(seed).normal(size=d), locked)
    v /= np.linalg.norm(v)
    vs, ps, zs, alphas, betas = [v], [], [], [], []
    scale = 0.0
    while True:
        q = vs[-1] - (betas[-1] * ps[-1] if betas else 0.0)
        for _ in range(2):                     # at right angles to every earlier left vector
            for p, z in zip(ps, zs):
                q = q - (z @ q) * p
        norm2, back = product(q)
        alpha = float(np.sqrt(max(norm2, 0.0)))
        scale = max(scale, alpha)
        if alpha <= 1e-13 * scale:             # the rest of the run's space has no deviation
            ps.append(np.zeros(d))
            zs.append(np.zeros(d))
            alphas.append(0.0)
            beta, r = 0.0, np.zeros(d)
        else:
            ps.append(q / alpha)
            zs.append(back / alpha)
            alphas.append(alpha)
            r = _orthogonal(zs[-1] - alpha * vs[-1], locked + vs)
            beta = float(np.linalg.norm(r))
        k = len(alphas)
        left, sigma, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        over = k == room or beta <= 1e-13 * scale or (k >= CHECK_STEPS and sigma[0] + beta < least)
        gaps = np.array([min((abs(s - t) for j, t in enumerate(sigma) if j != i), default=s) for i, s in enumerate(sigma)])
        error = beta * np.abs(left[-1])
        if over or (wanted < k <= room // 2 and (error[:wanted] <= tolerance * gaps[:wanted]).all()):
            return sigma, right @ np.array(vs), k, k == room
        betas.append(beta)
        vs.append(r / beta)


def fit(rows: DataFrame, components: int = 8, tolerance: float = 1e-12) -> Whitening | None:
    """The first ``components`` principal components of the integer vectors
    ``rows`` (id, x).  Directions without deviation (eigenvalue at rounding
    zero) are no components; no rows, or rows that are all equal, give none."""
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = head["n"], head["d"]
    if not n:
        return None
    sums = _exact_sums(rows, d)

    def centred(x: np.ndarray) -> np.ndarray:
        return _offsets(x, n, sums).astype(np.float64) / (n * np.sqrt(n))

    trace = float(_summed(rows, lambda x: np.array([(centred(x) ** 2).sum()]), 1)[0])

    def product(q: np.ndarray) -> tuple[float, np.ndarray]:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            u = c @ q
            return np.concatenate([[u @ u], u @ c])
        total = _summed(rows, part, d + 1)
        return total[0], total[1:]

    values, vectors, passes = np.zeros(0), np.zeros((0, d)), 0
    while trace > 0 and len(values) < d:
        first, wanted = not len(values), min(components, d)
        least = np.sort(values)[::-1][wanted - 1] if len(values) >= wanted else -1.0
        sigma, right, k, complete = bidiagonalise(
            product, d, components if first else 1, list(vectors), len(values), tolerance, least)
        passes += k
        if not first and sigma[0] <= least * (1 + 1e-9):
            break
        keep = len(sigma) if complete else min(len(sigma), components if first else 1)
        values = np.concatenate([values, sigma[:keep]])
        vectors = np.concatenate([vectors, right[:keep]])
        if complete:
            break
    order = np.argsort(-values, kind="stable")[:components]
    order = [i for i in order if values[i] ** 2 > 1e-14 * trace]
    # the basis to double precision: unit length, right angles
    basis: list[np.ndarray] = []
    for i in order:
        v = _orthogonal(vectors[i], basis)
        basis.append(v / np.linalg.norm(v))
    return Whitening(n, sums, trace, values[order] ** 2, np.array(basis).reshape(len(basis), d), passes)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened array<double>) of the integer vectors ``rows``.
    ``deviation`` is the exact sum of (n x - S)² over the dimensions, null
    where it is beyond a long."""
    n, sums, basis = model.n, model.sums, model.components
    scaled = basis / np.sqrt(model.eigenvalues)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            off = _offsets(_matrix(b.column(1)), n, sums)
            most = int(np.abs(off).max(initial=0))
            if most * most * off.shape[1] > LONG_MAX:
                off_exact = off.astype(object)
                dev = [v if v <= LONG_MAX else None for v in (off_exact * off_exact).sum(axis=1)]
            else:
                dev = (off * off).sum(axis=1)
            y = (off.astype(np.float64) / n) @ scaled.T
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dev, pa.int64()), flat],
                                             names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of (covariance of the whitened rows) - identity."""
    n, sums, m = model.n, model.sums, len(model.eigenvalues)
    scaled = model.components / np.sqrt(model.eigenvalues)[:, None]

    def part(x: np.ndarray) -> np.ndarray:
        y = (_offsets(x, n, sums).astype(np.float64) / n) @ scaled.T
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    total = _summed(rows, part, m + m * m)
    mean = total[:m] / n
    return float(np.abs(total[m:].reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())


def whitened_rows(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one
    row per remaining vector and component.  Repeated rows count and return as
    often as they occur, null ids too; other columns are ignored; no rows come
    back where no component exists (see ``fit``)."""
    rows = integer_vectors(df, id_col, vec_col)
    model = fit(rows, components)
    if model is None or not len(model.eigenvalues):
        return rows.limit(0).select(F.col("id").alias(id_col), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
                                    F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"),
                                    F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    error = identity_error(rows, model)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
    return (whiten(rows, model).select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"),
                    F.lit(error).alias("identity_error")))
