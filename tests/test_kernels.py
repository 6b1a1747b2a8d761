"""Kernels against brute force."""

import math

import numpy as np
import pytest

from panelloom.functions import kernels as K

rng = np.random.default_rng(11)


def test_rolling_betas_match_least_squares():
    x = rng.normal(size=(60, 3))
    y = x @ [0.5, -1.0, 2.0] + rng.normal(size=60)
    got = K.rolling_betas(y, x, 20)
    assert np.isnan(got[:19]).all()
    for t in range(19, 60):
        a = np.column_stack([np.ones(20), x[t - 19 : t + 1]])
        want = np.linalg.lstsq(a, y[t - 19 : t + 1], rcond=None)[0][1:]
        assert np.allclose(got[t], want)


def test_mirror_regressors_share_their_coefficient():
    x = rng.normal(size=(100, 1))
    both = np.column_stack([x, -x])
    beta = K.rolling_betas(2 * x[:, 0], both, 100)[-1]
    assert np.allclose(beta, [1.0, -1.0], atol=1e-6)


def test_hac_against_direct_sandwich():
    x = rng.normal(size=(80, 2))
    y = 0.3 + x @ [1.0, -0.5] + rng.normal(size=80)
    fit = K.ols_hac(y, x, 5)
    a = np.column_stack([np.ones(80), x])
    b = np.linalg.solve(a.T @ a, a.T @ y)
    e = y - a @ b
    meat = np.zeros((3, 3))
    for s in range(80):
        for t in range(80):
            if abs(s - t) <= 5:
                meat += (1 - abs(s - t) / 6) * e[s] * e[t] * np.outer(a[s], a[t])
    inv = np.linalg.inv(a.T @ a)
    assert np.allclose(fit["beta"], b)
    assert np.allclose(fit["se"], np.sqrt(np.diag(inv @ meat @ inv)))
    assert fit["p"][1] == pytest.approx(math.erfc(abs(fit["t"][1]) / math.sqrt(2)))


def slow_elastic_net(gram, cross, l1, l2):
    b = np.zeros(len(cross))
    for _ in range(20000):
        old = b.copy()
        for j in range(len(b)):
            part = cross[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(part) * max(abs(part) - l1, 0) / (gram[j, j] + l2)
        if np.abs(b - old).max() < 1e-13:
            break
    return b


def test_elastic_net_paths_match_coordinate_descent():
    x = rng.normal(size=(120, 5))
    x[:, 4] = x[:, 3] + 0.1 * rng.normal(size=120)
    y = x @ [1.0, 0.0, 0.3, 0.5, 0.0] + rng.normal(size=120)
    gram, cross, _, _ = K._moments(x, y)
    l1, l2 = np.array([0.5, 0.1, 0.02]), np.array([0.1, 0.05, 0.0])
    got = K.elastic_net_paths(gram[None], cross[None], l1, l2, steps=50000, tol=1e-12)[0]
    for i in range(3):
        want = slow_elastic_net(gram, cross, l1[i], l2[i])
        assert np.allclose(got[i], want, atol=1e-6)
        assert ((np.abs(got[i]) > 1e-10) == (np.abs(want) > 1e-10)).all()


def test_selection_keeps_signal_and_never_returns_nothing():
    x = rng.normal(size=(300, 6))
    y = 1.2 * x[:, 0] + rng.normal(size=300)
    assert 0 in K.elastic_net_select(x, y)
    assert len(K.elastic_net_select(x, rng.normal(size=300) * 1e-9)) >= 1


def test_budget_projection():
    for _ in range(50):
        n = int(rng.integers(2, 12))
        low, high = np.zeros(n), np.full(n, 1.5 / n)
        v = rng.normal(size=n)
        w = K.project_budget(v, low, high)
        assert w.sum() == pytest.approx(1.0)
        assert (w >= low - 1e-12).all() and (w <= high + 1e-12).all()
        # optimality: no feasible pairwise exchange brings w closer to v
        g = w - v
        up, down = w < high - 1e-9, w > low + 1e-9
        if up.any() and down.any():
            assert g[up].min() >= g[down].max() - 1e-9


@pytest.mark.parametrize("objective", ["min_variance", "mean_variance", "max_sharpe", "max_diversification"])
def test_allocations_beat_random_feasible_weights(objective):
    a = rng.normal(size=(8, 8))
    cov, mu = a @ a.T / 8 + 0.05 * np.eye(8), rng.normal(size=8) * 0.1
    low, high = np.zeros(8), np.full(8, 0.4)
    w, ok = K.allocate(cov, mu, low, high, objective, 1.0, 0.01)
    assert ok and w.sum() == pytest.approx(1.0) and w.max() <= 0.4 + 1e-9

    def loss(v):
        var = v @ cov @ v
        return {
            "min_variance": var,
            "mean_variance": var / 2 - mu @ v,
            "max_sharpe": -(mu @ v - 0.01) / np.sqrt(var),
            "max_diversification": -(np.sqrt(np.diag(cov)) @ v) / np.sqrt(var),
        }[objective]

    for _ in range(300):
        other = K.project_budget(w + rng.normal(size=8) * 0.1, low, high)
        assert loss(w) <= loss(other) + 1e-9
