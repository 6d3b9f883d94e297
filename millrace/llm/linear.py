"""A logistic scorer on sparse rows, fitted on the driver on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, width: int, l2: float = 1e-4, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias for soft targets in 0..1, by Adam on the whole sample; deterministic."""
    n = len(target)
    w, b = np.zeros(width), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))) if n else 0.0
    if not n:
        return w, -3.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=values * w[cols], minlength=n) + b
        err = (sigmoid(z) - target) / n
        g, gb = np.bincount(cols, weights=values * err[rows], minlength=width) + l2 * w, float(err.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= a * m / (np.sqrt(v) + 1e-8)
        b -= a * mb / (np.sqrt(vb) + 1e-8)
    return w, b
