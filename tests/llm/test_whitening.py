from collections import Counter

import numpy as np
import pytest

from runledger.llm import whitening
from tests.llm.vectors import empty, finite, rows, table


def brute(own, components):
    """By numpy's eigenvectors and Python integers."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in own]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviations, centred @ axes / np.sqrt(e), e / np.trace(v)


def check(docs, own, components):
    got = whitening.whiten(docs, components).collect()
    n, deviations, white, explained = brute(own, components)
    assert len(got) == n * components
    assert Counter((r.vec_id, r.component, r.deviation) for r in got) == Counter(
        (i, c + 1, dev) for (i, _), dev in zip(own, deviations, strict=True) for c in range(components))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(components):
        mine = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == c + 1}
        want = np.array([mine[i, dev] for (i, _), dev in zip(own, deviations, strict=True)])
        assert min(np.abs(want - white[:, c]).max(), np.abs(want + white[:, c]).max()) < 1e-8
        assert all(r.explained == pytest.approx(explained[c], rel=1e-12) for r in got if r.component == c + 1)


def test_against_numpy(spark):
    check(table(spark), finite(rows(), 8), 8)


def test_fewer_dimensions_than_components(spark):
    own = rows(n=60, d=3)
    got = whitening.whiten(table(spark, n=60, d=3)).collect()
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 3 * len(finite(own, 3))
    check(table(spark, n=60, d=3), finite(own, 3), 3)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[0.25, 0.5]] * 40, [None, []]])
def test_nothing_varies(spark, vectors):
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert whitening.whiten(docs).collect() == []


def test_no_rows(spark):
    assert whitening.whiten(empty(spark)).collect() == []


def test_one_direction_varies(spark):
    docs = spark.createDataFrame([(i, [float(i % 7), 1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<double>")
    got = whitening.whiten(docs).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_entries_that_no_long_holds(spark):
    docs = spark.createDataFrame([(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(docs).collect()
    assert {r.vec_id for r in got} == {0, 1, 2} and all(r.deviation is None or r.deviation > 0 for r in got)
    assert all(np.isfinite(r.whitened) for r in got) and got[0].identity_error < 1e-4


@pytest.mark.parametrize("spectrum", [np.arange(1, 21) ** 2.0, [9.0] * 5 + [4.0] * 3 + [1.0] * 12, [1e8, 1, 1e-3] + [1e-4] * 17,
                                      1 + np.arange(20) * 1e-13])
def test_slices_of_spectra(spectrum):
    """Wide, repeated, steep and all but equal eigenvalues."""
    rnd = np.random.default_rng(3)
    q = np.linalg.qr(rnd.standard_normal((20, 20)))[0]
    a = (q * np.array(spectrum, float)) @ q.T
    a = (a + a.T) / 2
    values, axes = whitening.leading(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:len(values)]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(axes @ axes.T - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ axes.T - axes.T * values).max() < 1e-13 * want[0]


def test_inertia_counts():
    rnd = np.random.default_rng(4)
    for _ in range(40):
        a = rnd.integers(-2, 3, (9, 9)).astype(float)
        a += a.T
        for shift in (0.1, -1.3, 2.7):
            assert whitening.inertia(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert whitening.inertia(np.array([[0.0, 1], [1, 0]]), 0) == 1
