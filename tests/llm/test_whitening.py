"""Components against a library's eigenvectors, sums against exact whole numbers, and hand-made tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from appfacts.llm.whitening import covariance, polar_factor, spectral_components, steps, whiten

SF = "/root/testdata/sf0.01"


def rotation(n, seed=1):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


@pytest.mark.parametrize(
    "matrix",
    [
        np.zeros((0, 0)),
        np.array([[5.0]]),
        np.zeros((4, 4)),
        3 * np.eye(8),
        np.diag(np.arange(8.0)),
        rotation(64) @ np.diag(10.0 ** -np.arange(0, 16, 0.25)) @ rotation(64).T,
        rotation(64) @ np.diag(np.repeat([1, 1 + 1e-9, 2, 3], 16)) @ rotation(64).T,
        rotation(24)[:, :5] @ rotation(24)[:, :5].T,
        np.ones((12, 12)),
    ],
)
def test_spectral_components(matrix):
    values, vectors = spectral_components(matrix)
    n, scale = len(matrix), max(np.abs(matrix).max(initial=0), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], rtol=0, atol=1e-13 * scale * max(n, 1))
    assert np.abs(vectors.T @ vectors - np.eye(n)).max(initial=0) < 1e-13
    assert np.abs(matrix @ vectors - vectors * values).max(initial=0) < 1e-13 * scale * max(n, 1)


def test_polar_factor_is_the_sign():
    q = rotation(20)
    e = np.concatenate((10.0 ** -np.arange(10), -(10.0 ** -np.arange(10))))
    assert np.abs(polar_factor(q @ np.diag(e) @ q.T) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-6


def brute(vectors):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(r) for r in x})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(s) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, (np.array(x) - np.array(s) / n) @ q[:, :16] / np.sqrt(np.maximum(e[:16], 1e-300)), e / e.sum()


def test_given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    plain = [(r.vec_id, r.embedding) for r in rows.collect()]
    n, deviation, whitened, explained = brute([v for _, v in plain])
    got = {}
    for r in whiten(rows).collect():
        got[r.vec_id, r.component] = r
    assert len(got) == 16 * len(plain)
    for i, (vec_id, _) in enumerate(plain):
        assert got[vec_id, 1].deviation == deviation[i] and got[vec_id, 1].n == n
    for k in range(16):
        mine = np.array([got[v, k + 1].whitened for v, _ in plain])
        sign = np.sign(mine @ whitened[:, k])
        assert np.abs(mine - sign * whitened[:, k]).max() < 1e-8
        assert got[plain[0][0], k + 1].explained == pytest.approx(explained[k], rel=1e-9)
    assert all(r.identity_error < 1e-9 for r in got.values())


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, n int, whitened string")


def test_hand_made(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.0, 1.0, 3.0], [1.0, 0.0, 3.0], [2.0, 2.0, 3.0], [-3.0, 4.0, 3.0]]
    rows = [(i, v, 0, 0, "x") for i, v in enumerate(good)]
    rows += [(10, good[0], 0, 0, "copy"), (10, good[0], 0, 0, "copy"), (None, good[1], 0, 0, "no key")]
    rows += [(20 + i, v, 0, 0, "bad") for i, v in enumerate([None, [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [1.0], []])]
    got = whiten(table(spark, rows)).collect()
    # The third dimension never changes, so two components are left.
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted(
        (i is None, i or 0, c) for i in (0, 1, 2, 3, 10, 10, None) for c in (1, 2)
    )
    n, deviation, _, explained = brute(good)
    assert {r.n for r in got} == {n} and {r.vec_id: r.deviation for r in got if r.vec_id in range(4)} == dict(enumerate(deviation))
    assert all(r.identity_error < 1e-12 for r in got)
    assert {r.component: round(r.explained, 12) for r in got} == {k + 1: round(explained[k], 12) for k in range(2)}
    assert whiten(table(spark, rows[:1])).count() == 0 and whiten(table(spark, [])).count() == 0


def test_large_entries_are_exact(spark):
    rows = [(i, [float(x), float(-x * 3)], 0, 0, "") for i, x in enumerate([1 << 30, (1 << 30) + 5, (1 << 30) - 77, 3])]
    fit = table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>")).select(steps("embedding").alias("x"))
    n, sums, v = covariance(fit, "x", 2)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] for r in rows]
    from fractions import Fraction

    mean = [Fraction(sum(c), 4) for c in zip(*x, strict=True)]
    want = [[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / 4) for j in range(2)] for i in range(2)]
    assert n == 4 and sums == [sum(c) for c in zip(*x, strict=True)] and v.tolist() == want
