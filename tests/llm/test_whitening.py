"""Operator 11 against dense eigenvectors of the same covariance."""

import numpy as np
import pytest

from replaygate.llm import whitening as W


@pytest.mark.parametrize("dim,n,seed", [(64, 500, 0), (120, 3000, 1), (16, 90, 2), (5, 40, 3), (1, 9, 4)])
def test_eigenpairs_match_dense_ones(dim, n, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim)) * np.linspace(5, 9, dim)
    c = np.cov(x.T, bias=True).reshape(dim, dim)
    values, vectors, residual = W.jacobi_davidson(lambda v: c @ v, dim, 16)
    want = np.linalg.eigvalsh(c)[::-1][:16]
    assert np.allclose(values, want, rtol=1e-12) and residual <= 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(c @ vectors - vectors * values).max() < 1e-11 * want[0]


def test_equal_eigenvalues_and_rank():
    c = np.diag([5.0] * 10 + [1.0] * 30)
    assert np.allclose(W.jacobi_davidson(lambda v: c @ v, 40, 16)[0], [5] * 10 + [1] * 6)
    c = np.diag([3.0, 2.0] + [0.0] * 18)
    assert np.allclose(W.jacobi_davidson(lambda v: c @ v, 20, 4)[0], [3, 2, 0, 0], atol=1e-14)


def test_minres_solves_shifted_symmetric_systems():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a, b, shifts = a + a.T, rng.standard_normal((30, 3)), np.array([0.3, -2.0, 11.0])
    z = W.minres(lambda v: a @ v, shifts, lambda w: w, b, 200)
    assert np.abs(a @ z - shifts * z - b).max() < 1e-8
    few = W.minres(lambda v: a @ v, shifts, lambda w: w, b, 4)
    assert (np.linalg.norm(a @ few - shifts * few - b, axis=0) < np.linalg.norm(b, axis=0)).all()


def brute(vecs, k=16):
    x = np.floor(64 * np.asarray(vecs, dtype=float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    w, q = np.linalg.eigh(np.cov(u.T, bias=True).reshape(x.shape[1], -1))
    keep = w[::-1][:k] > 1e-9 * w[-1]
    w, q = w[::-1][:k][keep], q[:, ::-1][:, :k][:, keep]
    explained = w / np.cov(u.T, bias=True).reshape(x.shape[1], -1).trace()
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q / np.sqrt(w), explained


def check(rows, vecs, ids):
    n, deviation, whitened, explained = brute(vecs)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    for i, v in enumerate(ids):
        mine = [got[v][c + 1] for c in range(whitened.shape[1])]
        assert len(got[v]) == whitened.shape[1]
        assert all(r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-8 for r in mine)
        assert np.allclose(np.abs([r["whitened"] for r in mine]), np.abs(whitened[i]), atol=1e-7)
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-9)


def test_given_vectors(spark):
    from tests.conftest import SF001
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    check(W.query(spark, SF001).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_dropped_repeated_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    good = [[float(x) for x in v] for v in rng.standard_normal((40, 6))]
    good += [good[0]] * 30  # a third of all rows
    rows = [(i, v, i, "x") for i, v in enumerate(good)]
    rows += [(100, None, 0, ""), (101, [], 0, ""), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, None), (103, [float("nan")] * 6, 0, ""), (104, [float("inf")] + [0.0] * 5, 0, ""), (105, [1.0, 2.0], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string")
    got = W.whiten(df).collect()
    kept = df.filter("vec_id < 100").collect()
    check(got, [r["embedding"] for r in kept], [r["vec_id"] for r in kept])
    assert len(got) == 70 * 6
    null_id = spark.createDataFrame([(None, v) for v in good[:20]] + [(1, good[30]), (1, good[31])], "vec_id long, embedding array<double>")
    assert W.whiten(null_id).count() == 22 * 6


def test_tables_without_variance_give_no_row(spark):
    schema = "vec_id long, embedding array<double>"
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []


def test_numbers_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<double>")
    got = W.whiten(df, components=1).collect()
    assert len(got) == 3 and sum(r["deviation"] is None for r in got) == 2 and all(np.isfinite(r["whitened"]) for r in got)
