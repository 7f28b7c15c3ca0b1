"""Whitening of embeddings: leading components of the covariance by LOBPCG over distributed products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, table

#: Entries become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Directions that are iterated beside those asked for: they make the gap that decides the speed.
GUARD = 16
#: A component is certified if |V x - e x| is within so many parts of the greatest eigenvalue.
CERTIFIED = 1e-13
#: Rounds, at most; rounds without a better residual, and what is accepted then at most.
MOST_ROUNDS, PATIENCE, ACCEPTED = 300, 3, 1e-11
#: Variance below this share of the greatest one is none.
NO_VARIANCE = 1e-13


@dataclass
class Whitening:
    """What a fit has learned: of n vectors the sums S by dimension, unit components (columns), their variances, the trace, and residuals over the greatest variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    residuals: np.ndarray
    rounds: int


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, v`` of the rows whose vector is there, without null or non-finite entries and of the commonest length (the least of equals); and that length."""
    entry = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = entry.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    lengths = finite.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d")))).first()
    d = lengths[0] or 0
    return finite.where(F.size("v") == d), d


def _whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's vectors as whole numbers, a row each."""
    values = np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(-1, d)
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def _summed(rows: DataFrame, made, shape: tuple[int, int], kind: str) -> np.ndarray:
    """Sum over all batches of the matrix that ``made`` gives: one per task, added up by row in Spark; the driver gets one matrix."""
    n, width = shape
    names = [f"c{j}" for j in range(width)]
    numbers = np.int64 if kind == "long" else np.float64

    def run(batches):
        claim("whitening")
        total = np.zeros(shape, dtype=numbers)
        some = False
        for batch in batches:
            if batch.num_rows:
                total, some = total + made(batch), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]], names=["i", *names])

    parts = rows.select("v").mapInArrow(run, "i int, " + ", ".join(f"{c} {kind}" for c in names))
    out = np.zeros(shape, dtype=numbers)
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["i"]] = [r[c] for c in names]
    return out


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the space of ``against``; directions that add nothing are left out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    if not block.size:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10 * max(1.0, s[0])]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


def fit(rows: DataFrame, d: int, components: int = 8, guard: int = GUARD, seed: int = 11) -> Whitening | None:
    """The ``components`` leading eigenvectors of the covariance of whole-numbered vectors (see ``usable``); None without rows.

    LOBPCG: each round one pass over the rows gives the covariance's product with a
    block of new directions, centred rows times block and their transpose times
    that, so no d x d matrix is built.  The driver then solves the small problem over
    the iterate, its residuals and the previous directions (all orthonormal), and
    takes the best ``components + guard`` combinations.  Rounds end when every
    residual, taken from a product of the iterate itself, is within CERTIFIED of the
    greatest variance, or no longer shrinks (ACCEPTED is an error).  The driver
    holds a few d x 3m matrices, whatever the number of rows.
    """
    def first(batch):
        x = _whole(batch, d)
        return np.stack([x.sum(axis=0), np.full(d, len(x))], axis=1)

    if not d:
        return None
    counted = _summed(rows, first, (d, 2), "long")
    sums, n = counted[:, 0], int(counted[0, 1])
    if not n:
        return None

    def product(block: np.ndarray) -> np.ndarray:
        """V times the block, and the rows' variance by dimension beside it."""
        def add(batch):
            x = centred(_whole(batch, d), n, sums)
            return np.column_stack([x.T @ (x @ block), (x**2).sum(axis=0)])

        return _summed(rows, add, (d, block.shape[1] + 1), "double") / n

    m = min(d, components + guard)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    p = np.empty((d, 0))
    out = product(x)
    vx, trace = out[:, :m], float(out[:, m].sum())
    best, since = np.inf, 0
    k = min(components, d)
    for turn in range(1, MOST_ROUNDS + 1):
        e, c = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        x, vx, e = x @ c[:, ::-1], vx @ c[:, ::-1], e[::-1]
        r = vx - x * e
        left = np.linalg.norm(r[:, :k], axis=0) / max(e[0], np.finfo(float).tiny)
        worst = left.max()
        if worst > CERTIFIED and turn < MOST_ROUNDS:
            best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if worst <= CERTIFIED or since > PATIENCE or turn == MOST_ROUNDS or e[0] <= 0 or m == d:
            # the certificate is a product of the iterate itself
            vx = product(x)[:, :m]
            e = np.einsum("ij,ij->j", x, vx)
            left = np.linalg.norm(vx[:, :k] - x[:, :k] * e[:k], axis=0) / max(e[0], np.finfo(float).tiny)
            if left.max() <= CERTIFIED * 10 or since > PATIENCE or e[0] <= 0 or m == d:
                break
        w = _orthonormal(r, x)
        p = _orthonormal(p, np.column_stack([x, w]))
        added = np.column_stack([w, p])
        basis, image = np.column_stack([x, added]), np.column_stack([vx, product(added)[:, :-1]]) if added.shape[1] else vx
        e, c = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        c = c[:, ::-1][:, :m]
        p = added @ c[m:]
        x, vx = basis @ c, image @ c
    if left.max() > ACCEPTED and e[0] > 0:
        raise RuntimeError(f"components are not certified after {turn} rounds: residual {left.max():.2g}")
    x = x[:, :k]
    # the greatest entry of a component is positive
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return Whitening(n, sums, x, np.maximum(e[:k], 0.0), trace, left, turn)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n; the difference is taken in whole numbers."""
    return (x * n - sums).astype(np.float64) / n


def _projection(found: Whitening) -> np.ndarray:
    """What centred rows are multiplied with; zero for a component without variance."""
    some = found.variances > NO_VARIANCE * max(found.variances[0], 0.0)
    return np.where(some, found.components / np.sqrt(np.where(some, found.variances, 1.0)), 0.0)


def _exact(apart: np.ndarray, d: int) -> pa.Array:
    """Sums of squares of whole numbers by row; NULL where 64 bits do not hold one."""
    if len(apart) and float(np.abs(apart).max()) ** 2 * d >= 2.0**63:
        return pa.array([s if (s := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in apart], pa.int64())
    return pa.array((apart**2).sum(axis=1))


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", guard: int = GUARD) -> DataFrame:
    """A row for each usable vector and component: ``vec_id, component`` (from 1), ``n, deviation, whitened, explained, identity_error``.

    Vectors that are null, hold null or non-finite entries, or have another length than
    most, are left out (see ``usable``).  Of the others each entry c counts as
    floor(1024 c) + 100000.  ``whitened`` is the centred vector on the component over
    the root of its variance; ``explained`` the variance over the trace;
    ``identity_error`` the greatest entry of the whitened covariance minus the identity,
    measured over all vectors; ``deviation`` the sum of (n x - S)^2, exact, NULL where
    64 bits do not hold it.  With fewer dimensions than ``components`` there are so
    many; a component without variance (one vector, equal vectors, fewer vectors than
    components) has ``whitened`` NULL and ``explained`` 0 and is left out of the
    identity.  Repeated rows each count and each give rows, a null id stays null;
    without usable vectors there are no rows.
    """
    spark = vectors.sparkSession
    rows, d = usable(vectors, id_col, vector_col)
    found = fit(rows, d, components, guard)
    if found is None:
        return spark.createDataFrame([], OUT)
    onto = _projection(found)
    k = onto.shape[1]
    some = np.abs(onto).max(axis=0) > 0

    def squares(batch):
        z = centred(_whole(batch, d), found.n, found.sums) @ onto
        return z.T @ z

    # rows are centred, so their projections are
    error = float(np.abs(_summed(rows, squares, (k, k), "double") / found.n - np.diag(some.astype(float)))[np.ix_(some, some)].max(initial=0.0))
    explained = found.variances / found.trace if found.trace > 0 else np.zeros(k)

    def run(batches):
        claim("whitening")
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch, d)
            z = centred(x, found.n, found.sums) @ onto
            apart = _exact(x * found.n - found.sums, d)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, found.n)), apart.take(each),
                pc.if_else(pa.array(np.tile(some, len(x))), pa.array(z.ravel()), pa.scalar(None, pa.float64())), pa.array(np.tile(np.where(some, explained, 0.0), len(x))), pa.array(np.full(len(x) * k, error)),
            ], names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)


def op11_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the eight leading components."""
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_lobpcg_whitening": op11_lobpcg_whitening}
ORACLES: dict[str, str] = {}  # eigenvectors: tests compare with a dense solver, and with exact sums
