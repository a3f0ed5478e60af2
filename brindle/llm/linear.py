"""Linear support vector machines for small samples, by dual coordinate descent (Hsieh et al. 2008)."""

from __future__ import annotations

import numpy as np


def hinge_fit(columns: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, width: int, *, cost: np.ndarray, epochs: int = 20,
              seed: int = 5) -> np.ndarray:
    """Weights, the last one of a constant 1, for rows given by their columns and values; labels are -1 or 1.

    The loss is the hinge, each row's dual variable lies between 0 and its ``cost``.
    """
    weights, alpha = np.zeros(width + 1), np.zeros(len(labels))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(labels)):
            c, v, y = columns[i], values[i], labels[i]
            slope = y * (weights[c] @ v + weights[width]) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                weights[c] += step * v
                weights[width] += step
                moved = max(moved, abs(step) / cost[i])
                alpha[i] = new
        if moved < 0.01:
            break
    return weights


def logistic_scale(margins: np.ndarray, positive: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities (Platt 1999), by Newton steps.

    The slope is not below 0, so a larger margin never has a smaller probability.
    """
    p, n = positive.sum(), (~positive).sum()
    goal = np.where(positive, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, float(np.log((p + 1) / (n + 1)))
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-9)
        ga, gb = ((q - goal) * margins).sum(), (q - goal).sum()
        haa, hab, hbb = (w * margins * margins).sum() + 1e-6, (w * margins).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-8:
            break
    return max(float(a), 0.0), float(b)
