"""Embedding whitening (11): against a dense eigensolver on all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def dense(vectors, k):
    """(n, deviations, whitened, explained) by a full covariance."""
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s).astype(np.longdouble) / n
    v = np.asarray(c.T @ c / n, dtype=float)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum(int(y) ** 2 for y in row) for row in x * n - s]
    return n, deviation, np.asarray(c, dtype=float) @ u / np.sqrt(e), e / np.trace(v)


def compare(df, ids, vectors, k=8, within=1e-9):
    n, deviation, z, explained = dense(vectors, k)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids)
    for j in range(k):
        mine = np.array([got[i][j + 1].whitened for i in ids])
        sign = np.sign(mine @ z[:, j])
        assert np.abs(mine - sign * z[:, j]).max() < within
    for i, dev in zip(ids, deviation):
        assert len(got[i]) == k
        for j in range(1, k + 1):
            r = got[i][j]
            assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(explained[j - 1], rel=1e-9) and 0 <= r.identity_error < 1e-9


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def spread(rng, n, d):
    """Vectors with a spectrum that falls slowly, away from the origin."""
    return rng.standard_normal((n, d)) * np.linspace(2, 0.3, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + rng.standard_normal(d) * 20


def test_query_against_a_dense_solver(spark, sf):
    """The registered query over its whole table."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    compare(whitening.QUERIES["op11_lobpcg_whitening"](spark, sf), [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("d", [3, 40, 300])
def test_few_and_many_dimensions(spark, d):
    """300 dimensions take many rounds: three blocks of 24 are far from the whole space."""
    v = spread(np.random.default_rng(d), 500, d)
    compare(whitening.whitened(frame(spark, v)), list(range(500)), v, min(8, d), 1e-7)
    rows, width = whitening.usable(frame(spark, v))
    found = whitening.fit(rows, width)
    assert found.residuals.max() <= whitening.ACCEPTED and (d != 300 or found.rounds > 5)
    assert np.abs(found.components.T @ found.components - np.eye(min(8, d))).max() < 1e-12


def test_a_third_of_all_rows_is_one_vector(spark):
    rng = np.random.default_rng(5)
    v = spread(rng, 200, 30)
    v = np.concatenate([v, np.repeat(v[:1], 100, axis=0)])
    compare(whitening.whitened(frame(spark, v).repartition(7)), list(range(300)), v)


def test_left_out_rows(spark):
    rng = np.random.default_rng(6)
    v = spread(rng, 60, 12)
    good = [(i, [float(c) for c in row]) for i, row in enumerate(v)]
    bad = [(100, None), (101, []), (102, [None] + [0.0] * 11), (103, [float("nan")] * 12), (104, [float("inf")] + [1.0] * 11), (105, [float("-inf")] + [1.0] * 11), (106, [1.0] * 11)]
    compare(whitening.whitened(spark.createDataFrame(good + bad, SCHEMA)), list(range(60)), v)


def test_ids_repeats_and_clashing_names(spark):
    v = spread(np.random.default_rng(7), 50, 10)
    rows = [(None if i % 9 == 0 else i % 20, [float(c) for c in row]) for i, row in enumerate(v)]
    plain = spark.createDataFrame(rows, SCHEMA)
    named = plain.select("*", *[F.lit(7).alias(c) for c in ("v", "n", "i", "component", "whitened", "deviation")])
    first, second = whitening.whitened(plain).collect(), whitening.whitened(named).collect()
    key = lambda r: (str(r.vec_id), r.component, r.deviation)
    assert len(first) == 400 and [key(r) for r in sorted(first, key=key)] == [key(r) for r in sorted(second, key=key)]
    assert sum(r.vec_id is None for r in first) == 6 * 8


def test_without_variance_or_rows(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    one = whitening.whitened(frame(spark, [[1.0, 2.0, 3.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(k, 1, 0, None, 0.0, 0.0) for k in (1, 2, 3)]
    two = whitening.whitened(frame(spark, [[0.0] * 10, [1.0] * 10])).collect()
    assert sorted((r.component, r.whitened is None) for r in two if r.vec_id == 0) == [(k, k > 1) for k in range(1, 9)]
    assert all(r.explained == pytest.approx(1.0) and abs(r.whitened) == pytest.approx(1.0) for r in two if r.component == 1)


def test_a_deviation_beyond_64_bits(spark):
    got = whitening.whitened(frame(spark, [[3e6], [-3e6], [0.0]])).collect()
    assert [r.deviation for r in sorted(got)] == [None, None, 0]
