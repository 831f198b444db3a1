"""Embedding whitening against dense linear algebra."""

import math

import numpy as np
import pytest

from curata.llm import queries as llm_queries
from curata.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component int"


def dense(vectors, k=16):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = ((n * fit - s) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    real = e > 1e-10 * e[0]
    e, u = e[real], u[:, real]
    w = ((n * x - s) / n).astype(float) @ u / np.sqrt(e)
    return n, [int(d) for d in ((n * x - s) ** 2).sum(1)], w, e / np.trace(centred.T @ centred / n)


def compare(got, ids, vectors, tolerance=1e-6):
    n, deviation, w, explained = dense(vectors)
    k = w.shape[1]
    assert len(got) == len(ids) * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    by = {(r.vec_id, r.component): r for r in got}
    assert {by[i, 1].deviation for i in ids} == set(deviation) and all(by[i, 1].deviation == d for i, d in zip(ids, deviation))
    found = np.array([[by[i, c].whitened for c in range(1, k + 1)] for i in ids])
    signs = np.sign((found * w).sum(0))
    assert np.abs(found * signs - w).max() < tolerance
    assert np.allclose([by[ids[0], c].explained for c in range(1, k + 1)], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    compare(llm_queries.op13_embedding_whitening(spark, sf_dir).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_repeated_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((40, 5)).astype("f4").tolist()
    rows = [(i, x) for i, x in enumerate(v)] + [(100 + i, v[0]) for i in range(30)]
    ids, vectors = [r[0] for r in rows], [r[1] for r in rows]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (904, [1.0]), (905, [])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], SCHEMA).repartition(5)
    got = whitening.transform(df, whitening.fit(df)).collect()
    compare(got, ids, vectors)
    copies = {r.vec_id: r.whitened for r in got if r.component == 1}
    assert copies[0] == copies[100] == copies[129]


def test_few_dimensions_vary_or_none(spark):
    rows = [(None if i == 3 else i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = whitening.transform(df, whitening.fit(df)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20 and sum(r.vec_id is None for r in got) == 1
    same = spark.createDataFrame([(i, [1.0, 2.0], 0, 0) for i in range(9)], SCHEMA)
    assert whitening.transform(same, whitening.fit(same)).count() == 0
    nothing = spark.createDataFrame([], SCHEMA)
    assert whitening.transform(nothing, whitening.fit(nothing)).count() == 0


def test_large_values(spark):
    rng = np.random.default_rng(8)
    v = (rng.standard_normal((30, 3)) * 1e9).astype("f4").tolist()
    df = spark.createDataFrame([(i, x, 0, 0) for i, x in enumerate(v)], SCHEMA)
    got = whitening.transform(df, whitening.fit(df)).collect()
    _, deviation, w, _ = dense(v)
    by = {(r.vec_id, r.component): r for r in got}
    assert [by[i, 1].deviation for i in range(30)] == [d if d < 1 << 63 else None for d in deviation]
    found = np.array([[by[i, c].whitened for c in (1, 2, 3)] for i in range(30)])
    assert np.abs(found * np.sign((found * w).sum(0)) - w).max() < 1e-6


@pytest.mark.parametrize(("size", "rank"), [(64, 64), (200, 200), (120, 30), (16, 16), (3, 3)])
def test_solver(size, rank):
    rng = np.random.default_rng(size)
    x = rng.standard_normal((500, rank)) @ rng.standard_normal((rank, size))
    x -= x.mean(0)
    v = x.T @ x / 500
    e, u, residual = whitening.jacobi_davidson(lambda b: x.T @ (x @ b) / 500, size, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.abs(e - want[: len(e)]).max() < 1e-13 * want[0] and residual.max() < 1e-12 * want[0]
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12


def test_minres_is_the_least_residual():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    q = np.linalg.qr(rng.standard_normal((20, 2)))[0]
    p = np.eye(20) - q @ q.T
    b = p @ rng.standard_normal(20)
    op = p @ (a - 0.3 * np.eye(20)) @ p
    for steps in (1, 3, 7):
        t = whitening.minres(lambda x: a @ x, np.array([0.3]), [q], b[:, None], steps)[:, 0]
        krylov = np.column_stack([np.linalg.matrix_power(op, j) @ b for j in range(steps)])
        y = np.linalg.lstsq(op @ krylov, b, rcond=None)[0]
        assert abs(np.linalg.norm(op @ t - b) - np.linalg.norm(op @ krylov @ y - b)) < 1e-8
