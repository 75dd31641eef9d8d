"""Non-negative factorisation by multiplicative updates (Lee and Seung; Fevotte and Idier for beta-divergences).  NumPy only."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
BETA = {"kullback-leibler": 1.0, "frobenius": 2.0, "itakura-saito": 0.0}


def divergence(v: np.ndarray, y: np.ndarray, beta: float = 1.0) -> float:
    """Generalised divergence of v from its model y; cells of v that are 0 add only the model's mass where beta is 1."""
    y = np.maximum(y, EPS)
    if beta == 2.0:
        return float(((v - y) ** 2).sum() / 2)
    if beta == 1.0:
        on = v > 0
        return float((v[on] * np.log(v[on] / y[on])).sum() - v.sum() + y.sum())
    ratio = np.maximum(v, EPS) / y
    return float((ratio - np.log(ratio) - 1).sum())


def start(v: np.ndarray, k: int, init: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starting factors: ``random``, or from a truncated SVD (``nndsvd``, zeros filled by the mean ``a`` or by noise ``ar``)."""
    rng = np.random.default_rng(seed)
    mean = np.sqrt(v.mean() / k)
    if init == "random":
        return np.abs(rng.standard_normal((v.shape[0], k))) * mean, np.abs(rng.standard_normal((k, v.shape[1]))) * mean
    u, s, t = np.linalg.svd(v, full_matrices=False)
    p, q = np.zeros((v.shape[0], k)), np.zeros((k, v.shape[1]))
    for j in range(min(k, len(s))):
        a, b = u[:, j], t[j]
        if j == 0:
            p[:, 0], q[0] = np.sqrt(s[0]) * np.abs(a), np.sqrt(s[0]) * np.abs(b)
            continue
        sides = [(np.maximum(sign * a, 0), np.maximum(sign * b, 0)) for sign in (1, -1)]
        x, y = max(sides, key=lambda side: np.linalg.norm(side[0]) * np.linalg.norm(side[1]))
        nx, ny = np.linalg.norm(x), np.linalg.norm(y)
        if nx and ny:
            scale = np.sqrt(s[j] * nx * ny)
            p[:, j], q[j] = scale * x / nx, scale * y / ny
    if init == "nndsvda":
        p[p == 0] = q[q == 0] = v.mean()
    elif init == "nndsvdar":
        for m in (p, q):
            m[m == 0] = np.abs(v.mean() * rng.standard_normal((m == 0).sum()) / 100)
    return p, q


def half_step(v: np.ndarray, p: np.ndarray, q: np.ndarray, beta: float, l1: float, l2: float) -> np.ndarray:
    """Update p for v ~ p q."""
    y = np.maximum(p @ q, EPS)
    if beta == 1.0:
        top, bottom = (v / y) @ q.T, np.broadcast_to(q.sum(axis=1), p.shape).copy()
    elif beta == 2.0:
        top, bottom = v @ q.T, y @ q.T
    else:
        top, bottom = (v / y**2) @ q.T, (1 / y) @ q.T
    bottom = bottom + l1 + l2 * p
    step = top / np.where(bottom == 0, EPS, bottom)
    return p * (np.sqrt(step) if beta == 0.0 else step)


def fit(
    v: np.ndarray,
    k: int,
    beta_loss: str = "kullback-leibler",
    alpha_p: float = 0.0,
    alpha_q: float = 0.0,
    l1_ratio: float = 0.0,
    init: str = "random",
    seed: int = 0,
    max_iter: int = 3000,
    tol: float = 1e-4,
    fixed: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """``v ~ p q``: (p, q, rounds).  With ``fixed`` as q only p is found, from a constant start.

    Penalties are per unit: alpha_p times the columns of v falls on p, alpha_q
    times its rows on q.  Every ten rounds the divergence is compared with the
    first; a gain of less than ``tol`` of it ends.
    """
    beta = BETA[beta_loss]
    pen_p, pen_q = alpha_p * v.shape[1], alpha_q * v.shape[0]
    if fixed is not None:
        q = fixed
        p = np.full((v.shape[0], k), np.sqrt(max(v.mean(), 0.0) / k))
    else:
        p, q = start(v, k, init, seed)
    first = last = np.sqrt(2 * max(divergence(v, p @ q, beta), 0.0))
    done = max_iter
    for turn in range(1, max_iter + 1):
        p = half_step(v, p, q, beta, pen_p * l1_ratio, pen_p * (1 - l1_ratio))
        if fixed is None:
            q = half_step(v.T, q.T, p.T, beta, pen_q * l1_ratio, pen_q * (1 - l1_ratio)).T
        if tol > 0 and turn % 10 == 0:
            now = np.sqrt(2 * max(divergence(v, p @ q, beta), 0.0))
            if first == 0 or (last - now) / first < tol:
                done = turn
                break
            last = now
    return p, q, done


def apply_fixed(v: np.ndarray, dense: np.ndarray, begin: float, rounds: int, tol: float = 0.0) -> np.ndarray:
    """Sample weights (signatures x samples) of v (features x samples) under fixed weights (features x signatures), by Kullback-Leibler updates.

    With ``tol``, every ten rounds samples whose loss fell by less than that share
    of their first loss are done, each by itself.
    """
    mass = np.maximum(dense.sum(axis=0), EPS)[:, None]
    h = np.full((dense.shape[1], v.shape[1]), begin)

    def losses(live: np.ndarray) -> np.ndarray:
        y, x = np.maximum(dense @ h[:, live], EPS), v[:, live]
        each = np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / y), 0).sum(axis=0) - x.sum(axis=0) + y.sum(axis=0)
        return np.sqrt(2 * np.maximum(each, 0))

    live = np.arange(v.shape[1])
    first = losses(live) if tol > 0 else None
    last = first
    for turn in range(1, rounds + 1):
        h[:, live] *= (dense.T @ (v[:, live] / np.maximum(dense @ h[:, live], EPS))) / mass
        if tol > 0 and turn % 10 == 0:
            now = losses(live)
            going = (first > 0) & (last - now >= tol * first)
            live, first, last = live[going], first[going], now[going]
            if not len(live):
                break
    return h


def holdout(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, k: int, **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gabriel holdout: factor D, carry its factors to B and C, predict A.  Returns prediction and its two factors."""
    p_d, h_d, _ = fit(d, k, **options)
    w_a, _, _ = fit(b, k, **{**options, "fixed": h_d})
    h_a, _, _ = fit(c.T, k, **{**options, "fixed": p_d.T})
    return w_a @ h_a.T, w_a, h_a.T


def measures(a: np.ndarray, y: np.ndarray, beta_loss: str = "kullback-leibler") -> dict[str, float | None]:
    """Fit of y to a: r_squared (null for a constant a), rss, cosine_similarity, l2_norm, reconstruction_error."""
    rss = float(((a - y) ** 2).sum())
    tss = float(((a - a.mean()) ** 2).sum())
    norm = float(np.sqrt((a**2).sum() * (y**2).sum()))
    return {
        "r_squared": 1 - rss / tss if tss > 0 else None,
        "rss": rss,
        "cosine_similarity": float((a * y).sum()) / norm if norm > 0 else None,
        "l2_norm": float(np.sqrt(rss)),
        "reconstruction_error": divergence(a, y, BETA[beta_loss]),
    }
