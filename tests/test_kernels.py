"""Numeric kernels, without Spark."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from partwise.kernels import nmf, small


@pytest.fixture
def v():
    rng = np.random.default_rng(3)
    return rng.random((12, 3)) @ rng.random((3, 15)) + 0.01


def test_updates_never_raise_the_divergence(v):
    p, q = nmf.start(v, 3, "random", 1)
    last = nmf.divergence(v, p @ q)
    for _ in range(30):
        p = nmf.half_step(v, p, q, 1.0, 0.0, 0.0)
        q = nmf.half_step(v.T, q.T, p.T, 1.0, 0.0, 0.0).T
        now = nmf.divergence(v, p @ q)
        assert now <= last + 1e-12
        last = now


def test_column_sums_are_kept_by_an_update(v):
    p, q = nmf.start(v, 3, "random", 2)
    q = nmf.half_step(v.T, q.T, p.T, 1.0, 0.0, 0.0).T
    assert np.allclose((p @ q).sum(axis=0), v.sum(axis=0))


@pytest.mark.parametrize("init", ["random", "nndsvd", "nndsvda", "nndsvdar"])
@pytest.mark.parametrize("beta", ["kullback-leibler", "frobenius"])
def test_fit_recovers_low_rank(v, init, beta):
    p, q, n = nmf.fit(v, 3, beta_loss=beta, init=init, seed=0, max_iter=2000, tol=1e-7)
    assert n <= 2000 and (p >= 0).all() and (q >= 0).all()
    assert nmf.measures(v, p @ q)["r_squared"] > 0.9


def test_rank_one_holdout_has_a_closed_form(v):
    a, b, c, d = v[:4, :5], v[:4, 5:], v[4:, :5], v[4:, 5:]
    y, _, _ = nmf.holdout(a, b, c, d, 1, max_iter=100)
    assert np.allclose(y, np.outer(b.sum(axis=1), c.sum(axis=0)) / d.sum())


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for shape in ((4, 4), (3, 5), (5, 3), (1, 2)):
        gain = rng.random(shape)
        got = sum(gain[i, j] for i, j in small.assign(gain))
        n, m = shape
        best = max(sum(gain[i, j] for i, j in zip(range(n), p, strict=False)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(gain[i, j] for j, i in zip(range(m), p, strict=False)) for p in itertools.permutations(range(n), m))
        assert got == pytest.approx(best)


def test_tails():
    assert small.normal_tail(1.959963984540054) == pytest.approx(0.05)
    assert small.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert small.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05)


def test_peak_and_knee():
    values = np.array([0.6, 1, 0.9, 0.92, 0.93, 0.98, 0.7, 0.6, 0.5, 0.4])
    assert small.peak(np.arange(2, 12), values) == 7
    order = np.random.default_rng(1).permutation(10)
    assert small.peak(np.arange(2, 12)[order], values[order]) == 7
    assert small.knee(np.arange(5), np.ones(5)) is None


def test_cliques_and_linkage():
    assert small.cliques(4, {(0, 1), (1, 2), (0, 2), (2, 3)}) == [[0, 1, 2], [2, 3]]
    d = np.array([[0, 0.1, 1, 1], [0.1, 0, 1, 1], [1, 1, 0, 0.2], [1, 1, 0.2, 0]])
    assert small.cophenetic(d) == pytest.approx(1.0)


def test_ordination_keeps_distances():
    points = np.random.default_rng(0).random((6, 2))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    got, _ = small.principal_coordinates(d)
    assert np.allclose(np.sqrt(((got[:, None] - got[None]) ** 2).sum(-1)), d)
