"""Whitening against a direct eigendecomposition, exact sums, ties and defined cases."""

import numpy as np
import pytest

from hoplattice.llm import whitening

RNG = np.random.default_rng(2)


def table(spark, vectors, kind="double", first=0):
    rows = [(first + k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def direct(x):
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return n, sums, centred, values[::-1], vectors[:, ::-1], np.trace(cov)


def compare(spark, raw, count):
    x = np.floor(64 * np.asarray(raw, np.float64)).astype(np.int64) + 1_000_000
    n, sums, centred, values, vectors, trace = direct(x)
    got = whitening.components_table(table(spark, raw)).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == n * count and (got.n == n).all() and got.identity_error.max() <= 1e-9
    white = got.whitened.to_numpy().reshape(n, count)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert (got.deviation.to_numpy().reshape(n, count) == deviation[:, None]).all()
    np.testing.assert_allclose(got.explained.to_numpy()[:count], values[:count] / trace, rtol=1e-9)
    return white, centred @ vectors[:, :count] / np.sqrt(values[:count]), values


def test_whitened_rows_equal_the_direct_way(spark):
    raw = RNG.normal(0, 1, (700, 40)) * np.linspace(2, 0.2, 40) @ np.linalg.qr(RNG.normal(size=(40, 40)))[0]
    white, want, _ = compare(spark, raw, 32)
    np.testing.assert_allclose(white * np.sign((white * want).sum(axis=0)), want, atol=1e-8)


def test_fewer_dimensions_than_components_and_dependent_columns(spark):
    base = RNG.integers(-90, 90, (60, 3)) / 64
    white, want, _ = compare(spark, np.column_stack([base, base[:, 0], np.full(60, 0.5)]), 3)
    np.testing.assert_allclose(white * np.sign((white * want).sum(axis=0)), want, atol=1e-8)


def test_equal_eigenvalues_are_all_found(spark):
    cube = np.array([[(k >> b & 1) * 2 - 1 for b in range(6)] for k in range(64)], float)
    white, _, values = compare(spark, cube, 6)
    assert np.ptp(values) < 1e-6
    np.testing.assert_allclose(white.T @ white / 64, np.eye(6), atol=1e-9)


def test_bidiagonal_steps_end_early_only_when_nothing_can_be_missing():
    x = RNG.normal(size=(900, 120)) * 0.5 ** np.arange(120)
    times = lambda g: np.append(x.T @ (x @ g), (x @ g) @ (x @ g))
    vectors, sigma, steps = whitening.bidiagonalise(times, 120, float((x * x).sum()), 4)
    _, want, right = np.linalg.svd(x, full_matrices=False)
    assert steps < 60
    np.testing.assert_allclose(sigma[:4], want[:4], rtol=1e-12)
    np.testing.assert_allclose(np.abs((right[:4] * vectors[:, :4].T).sum(axis=1)), 1, atol=1e-12)
    flat = np.linalg.qr(RNG.normal(size=(300, 30)))[0]
    vectors, sigma, steps = whitening.bidiagonalise(lambda g: np.append(flat.T @ (flat @ g), (flat @ g) @ (flat @ g)), 30, 30.0, 4)
    assert steps == 30
    np.testing.assert_allclose(sigma, 1, rtol=1e-10)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(30), atol=1e-10)


def test_left_vectors_are_orthogonal_too():
    x = RNG.normal(size=(200, 25)) * 3.0 ** -np.arange(25)
    seen = []

    def times(g):
        seen.append(x @ g)
        return np.append(x.T @ seen[-1], seen[-1] @ seen[-1])

    whitening.bidiagonalise(times, 25, float((x * x).sum()), 25)
    left = np.array([u / np.linalg.norm(u) for u in seen[:12]])
    np.testing.assert_allclose(left @ left.T, np.eye(12), atol=1e-8)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_odd_rows_are_dropped_and_repeated_ones_kept(spark, kind):
    good = [list(RNG.normal(size=4)) for _ in range(20)]
    odd = [None, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0, 0, 0], [1.0, 2.0], []]
    df = table(spark, good + odd, kind).union(table(spark, [good[0]], kind)).selectExpr("*", "'clash' AS whitened")
    got = whitening.components_table(df).toPandas()
    assert (got.n == 21).all() and len(got) == 21 * 4 and (got[got.vec_id == 0].groupby("component").whitened.agg(lambda w: w.max() - w.min()) < 1e-12).all()


def test_tables_without_variance_or_rows(spark):
    for vectors in ([], [None], [[]], [[1.0, 2.0]], [[0.5, 0.5]] * 5):
        assert whitening.components_table(table(spark, vectors)).count() == 0


def test_large_entries_are_exact_or_null(spark):
    raw = [[1e9, 0.0], [-1e9, 1.0], [0.0, 3.0]]
    model = whitening.fit(table(spark, raw))
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table(spark, raw), model).collect()}
    x = [[int(64 * c) for c in v] for v in raw]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for k, v in enumerate(x):
        exact = sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert got[k] == (exact if exact < 1 << 63 else None)
