"""Small dense linear algebra used inside Arrow batches.

Each function works on arrays of one bounded group (a regression window, a covariance
matrix); Spark does the grouping, shuffling and everything that scales.
"""

from __future__ import annotations

import math

import numpy as np

NORMAL_975 = 1.959963984540054


def solve_spd(gram: np.ndarray, rhs: np.ndarray, cutoff: float = 1e-12) -> np.ndarray:
    """Minimum-norm solution of (batched) normal equations.

    Columns are scaled to unit diagonal first; eigenvalues under ``cutoff`` of the
    largest are dropped, so mirror-image regressors share their coefficient.
    """
    scale = np.sqrt(np.maximum(np.einsum("...ii->...i", gram), 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    scaled = gram / (scale[..., :, None] * scale[..., None, :])
    values, vectors = np.linalg.eigh(scaled)
    keep = values > cutoff * values[..., -1:]
    inverse = np.where(keep, 1.0 / np.where(keep, values, 1.0), 0.0)
    projected = np.einsum("...ji,...j->...i", vectors, rhs / scale)
    return np.einsum("...ij,...j->...i", vectors, inverse * projected) / scale


def pseudo_inverse(gram: np.ndarray, cutoff: float = 1e-12) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    keep = values > cutoff * values[-1]
    inverse = np.where(keep, 1.0 / np.where(keep, values, 1.0), 0.0)
    return (vectors * inverse) @ vectors.T / np.outer(scale, scale)


def rolling_betas(y: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    """Slopes (intercept fitted, not returned) of every full trailing window.

    Windows are centred one by one before their moments are formed; leading rows
    without a full window are NaN.
    """
    n, k = x.shape
    out = np.full((n, k), np.nan)
    if n < window:
        return out
    joined = np.column_stack([x, y])
    view = np.lib.stride_tricks.sliding_window_view(joined, window, axis=0)
    step = max(1, 2_000_000 // (window * (k + 1)))
    for start in range(0, view.shape[0], step):
        block = view[start : start + step]
        block = block - block.mean(axis=2, keepdims=True)
        moments = block @ block.transpose(0, 2, 1)
        out[window - 1 + start : window - 1 + start + block.shape[0]] = solve_spd(
            moments[:, :k, :k], moments[:, :k, k]
        )
    return out


def normal_two_sided(t: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2.0)) if v == v else np.nan for v in t])


def ols_hac(y: np.ndarray, x: np.ndarray, lags: int) -> dict:
    """Least squares with intercept and Bartlett-weighted robust covariance."""
    n, k = x.shape
    design = np.column_stack([np.ones(n), x])
    bread = pseudo_inverse(design.T @ design)
    beta = bread @ (design.T @ y)
    resid = y - design @ beta
    score = design * resid[:, None]
    meat = score.T @ score
    for lag in range(1, min(lags, n - 1) + 1):
        cross = score[lag:].T @ score[:-lag]
        meat += (1.0 - lag / (lags + 1.0)) * (cross + cross.T)
    cov = bread @ meat @ bread
    se = np.sqrt(np.maximum(np.diag(cov), 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
    total = float(((y - y.mean()) ** 2).sum())
    rss = float(resid @ resid)
    r2 = 1.0 - rss / total if total > 0 else np.nan
    free = n - k - 1
    return {
        "beta": beta,
        "se": se,
        "t": t,
        "p": normal_two_sided(t),
        "low": beta - NORMAL_975 * se,
        "high": beta + NORMAL_975 * se,
        "adjusted_r2": 1.0 - (1.0 - r2) * (n - 1) / free if free > 0 else np.nan,
        "residual_vol": float(resid.std(ddof=1) * math.sqrt(252.0)),
    }


def elastic_net_paths(
    gram: np.ndarray, cross: np.ndarray, l1: np.ndarray, l2: np.ndarray, *, steps: int = 2000, tol: float = 1e-7
) -> np.ndarray:
    """Elastic-net coefficients of every penalty for every problem, all at once.

    Minimises b'Gb/2 - c'b + l1*|b| + l2*b'b/2.  ``gram`` (f, k, k) and ``cross`` (f, k) hold one
    problem per fold; ``l1`` and ``l2`` (p,) one penalty each.  Accelerated proximal
    gradient with restarts, so an iteration is one matrix product per fold; exact zeros
    come from the proximal step.  Returns (f, p, k).
    """
    f, k = cross.shape
    bound = np.linalg.eigvalsh(gram)[:, -1][:, None, None] + l2[None, :, None]
    rate = 1.0 / np.maximum(bound, 1e-300)
    beta = np.zeros((f, len(l1), k))
    look, momentum = beta, 1.0
    cut = rate * l1[None, :, None]
    keep = 1.0 - rate * l2[None, :, None]
    push = rate * cross[:, None, :]
    scale = float(np.abs(cross).max()) or 1.0
    for step in range(steps):
        raw = keep * look - rate * (look @ gram) + push
        new = np.sign(raw) * np.maximum(np.abs(raw) - cut, 0.0)
        move = new - beta
        if step % 10 == 9 and float(np.abs(move).max()) < tol * scale:
            return new
        if float(((look - new) * move).sum()) > 0:
            momentum, look = 1.0, new
        else:
            grown = (1.0 + math.sqrt(1.0 + 4.0 * momentum * momentum)) / 2.0
            look = new + ((momentum - 1.0) / grown) * move
            momentum = grown
        beta = new
    return beta


def _moments(x: np.ndarray, y: np.ndarray):
    mx, my = x.mean(axis=0), y.mean()
    xc, yc = x - mx, y - my
    n = len(y)
    return xc.T @ xc / n, xc.T @ yc / n, mx, my


# Fixed values of the selection grid.
L1_RATIOS = (0.25, 0.5, 0.75, 0.95)
PATH_LENGTH = 100
PATH_SPAN = 1e-3


def elastic_net_select(x: np.ndarray, y: np.ndarray, alpha=1e-4, l1_ratio=0.5) -> np.ndarray:
    """Indices kept by a cross-validated elastic net on standardised regressors.

    Contiguous folds, one penalty path per mixing ratio; all (ratio, penalty, fold)
    problems are solved together on fold-level moments.
    """
    n, k = x.shape
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    gram, cross, _, _ = _moments(z, y)
    if n < max(30, 3 * k):
        chosen = (alpha * l1_ratio, alpha * (1 - l1_ratio))
    else:
        folds = np.array_split(np.arange(n), min(5, max(2, n // 20)))
        ratios = np.array(L1_RATIOS)
        grid = (np.abs(cross).max() / ratios)[:, None] * np.logspace(0, math.log10(PATH_SPAN), PATH_LENGTH)
        l1 = (grid * ratios[:, None]).ravel()
        l2 = (grid * (1 - ratios)[:, None]).ravel()
        train = []
        for fold in folds:
            keep = np.ones(n, bool)
            keep[fold] = False
            train.append(_moments(z[keep], y[keep]))
        paths = elastic_net_paths(np.stack([t[0] for t in train]), np.stack([t[1] for t in train]), l1, l2)
        errors = np.zeros(len(l1))
        for fold, (_, _, mx, my), coefs in zip(folds, train, paths):
            fitted = (z[fold] - mx) @ coefs.T + my
            errors += ((y[fold][:, None] - fitted) ** 2).mean(axis=0)
        best = int(np.argmin(errors))
        chosen = (l1[best], l2[best])
    coef = elastic_net_paths(gram[None], cross[None], np.array([chosen[0]]), np.array([chosen[1]]), steps=20000, tol=1e-10)[0, 0]
    kept = np.flatnonzero(np.abs(coef) > 1e-10)
    if not len(kept):
        sd = x.std(axis=0)
        corr = np.abs(cross * spread) / np.where(sd > 0, sd, np.inf)
        kept = np.array([int(np.argmax(corr))])
    return kept


def project_budget(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Nearest point with low <= w <= high and sum(w) = 1.

    sum(clip(v - shift)) falls piecewise linearly; its kinks are walked in sorted order.
    """
    kinks = np.concatenate([v - high, v - low])
    turn = np.concatenate([np.full(len(v), -1.0), np.ones(len(v))])
    order = np.argsort(kinks, kind="stable")
    kinks, slope = kinks[order], np.cumsum(turn[order])
    total = high.sum() + np.concatenate([[0.0], np.cumsum(slope[:-1] * np.diff(kinks))])
    i = int(np.searchsorted(-total, -1.0))
    if i <= 0 or i >= len(kinks) or slope[i - 1] == 0:
        shift = kinks[min(i, len(kinks) - 1)]
    else:
        shift = kinks[i - 1] + (total[i - 1] - 1.0) / -slope[i - 1]
    return np.clip(v - shift, low, high)


def allocate(
    cov: np.ndarray,
    mu: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    objective: str,
    risk_aversion: float = 1.0,
    risk_free: float = 0.0,
    sweeps: int = 2000,
) -> tuple[np.ndarray, bool]:
    """Budgeted box-constrained weights by spectral projected gradient.

    Step lengths from the last change of the gradient, non-monotone line search.
    """
    n = len(mu)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    if objective == "max_diversification":
        mu, risk_free, objective = sd, 0.0, "max_sharpe"

    def loss(w):
        var = float(w @ cov @ w)
        if objective == "min_variance":
            return var, 2 * cov @ w
        if objective == "mean_variance":
            return risk_aversion * var / 2 - float(mu @ w), risk_aversion * cov @ w - mu
        if objective == "max_sharpe":
            vol = math.sqrt(max(var, 1e-16))
            excess = float(mu @ w) - risk_free
            return -excess / vol, -mu / vol + excess * (cov @ w) / vol**3
        raise ValueError(f"unknown objective {objective}")

    w = project_budget(np.full(n, 1.0 / n), low, high)
    value, grad = loss(w)
    # Optimality is judged on the starting gradient's scale: inside the box the gradient
    # of a ratio vanishes at the optimum.
    size = max(float(np.abs(grad).max()), 1e-12)
    step = 1.0 / size
    recent = [value]
    for _ in range(sweeps):
        unit = grad / size
        if float(np.abs(project_budget(w - unit, low, high) - w).max()) < 1e-8:
            return w, True
        move = project_budget(w - step * grad, low, high) - w
        drop, part, bar = float(grad @ move), 1.0, max(recent)
        while True:
            trial = w + part * move
            new, new_grad = loss(trial)
            if new <= bar + 1e-4 * part * drop or part < 1e-12:
                break
            part /= 2
        change, bend = trial - w, new_grad - grad
        curve = float(change @ bend)
        step = min(max(float(change @ change) / curve, 1e-12), 1e12) if curve > 0 else 1e6 * step
        step = min(step, 1e12)
        stalled = float(np.abs(change).max()) < 1e-13
        w, value, grad = trial, new, new_grad
        recent = [*recent[-7:], value]
        if stalled:
            break
    unit = grad / size
    return w, float(np.abs(project_budget(w - unit, low, high) - w).max()) < 1e-5
