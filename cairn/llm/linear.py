"""Logistic models on the driver: small dense problems from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 2000, tolerance: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on the mean log loss plus l2 |w|^2 / 2n, until no gradient exceeds the tolerance. The momentum starts anew where it points uphill."""
    n, k = x.shape
    if n == 0 or y.min() == y.max():
        rate = np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6)
        return np.zeros(k, np.float32), float(np.log(rate / (1 - rate)))
    v = np.random.default_rng(0).random(k).astype(np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        u = x.T @ (x @ v)
        scale = float(np.linalg.norm(u)) or 1.0
        v = u / np.float32(scale)
    step = 1.0 / (0.25 * (scale / n + 1.0) * 1.1 + l2 / n)
    w, b = np.zeros(k, np.float32), float(np.log(y.mean() / (1 - y.mean())))
    pw, pb, t = w.copy(), b, 0
    for _ in range(rounds):
        t += 1
        m = (t - 1) / (t + 2)
        qw, qb = w + np.float32(m) * (w - pw), b + m * (b - pb)
        r = (sigmoid(x @ qw + qb) - y).astype(np.float32)
        gw, gb = x.T @ r / np.float32(n) + np.float32(l2 / n) * qw, float(r.mean())
        pw, pb = w, b
        w, b = qw - np.float32(step) * gw, qb - step * gb
        if max(float(np.abs(gw).max(initial=0)), abs(gb)) < tolerance:
            break
        if float(gw @ (w - pw)) + gb * (b - pb) > 0:
            t = 0
    return w, b
