"""Linear hinge-loss models by dual coordinate descent, and the calibration of their margins."""

from __future__ import annotations

import numpy as np


class SparseRows:
    """Rows of (column numbers, values)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.rows, self.width = rows, width

    def __len__(self) -> int:
        return len(self.rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.array([float(v @ w[i]) for i, v in self.rows])


class DenseRows:
    def __init__(self, x: np.ndarray):
        self.x, self.width = x, x.shape[1]
        self.rows = [(slice(None), r) for r in x]

    def __len__(self) -> int:
        return len(self.x)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w


def fit_hinge(x, y: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 7, balance: bool = True, bias: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise |w|^2 / 2 + sum of C_i * max(0, 1 - y_i (w.x_i + b)): one dual variable at a
    time is set to its best value in [0, C_i]. y: +1 or -1. balance: classes weigh the same in sum."""
    n = len(x)
    w, b = np.zeros(x.width), 0.0
    if n == 0:
        return w, b
    counts = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    upper = np.array([cost * (n / (2 * counts[int(s)]) if balance else 1.0) for s in y])
    size = np.array([float(v @ v) for _, v in x.rows]) + bias * bias
    alpha = np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(n):
            i, v = x.rows[k]
            gradient = y[k] * (float(v @ w[i]) + b * bias) - 1.0
            new = min(max(alpha[k] - gradient / size[k], 0.0), upper[k])
            step = new - alpha[k]
            if step:
                alpha[k] = new
                w[i] += (step * y[k]) * v
                b += step * y[k] * bias
                most = max(most, abs(step) * size[k])
        if most < 1e-3:
            break
    return w, b * bias


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, c) of the logistic 1 / (1 + exp(-(a * margin + c))), by Newton's method with smoothed targets."""
    pos, neg = int((label == 1).sum()), int((label != 1).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -35, 35)))
        grad = design.T @ (p - target) + 1e-3 * theta
        hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= step if np.abs(step).max() < 5 else step * 5 / np.abs(step).max()
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-6), float(theta[1])


def fit_logistic(x: np.ndarray, label: np.ndarray, ridge: float = 0.1, weight: float = 1.0) -> np.ndarray:
    """Intercept and weights of a logistic regression with smoothed targets, by Newton's method. weight: that of a row
    whose label is true."""
    pos, neg = int(label.sum()), int((~label).sum())
    target = np.where(label, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    each = np.where(label, weight, 1.0)
    theta, prior = np.zeros(design.shape[1]), ridge * np.eye(design.shape[1])
    prior[0, 0] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -35, 35)))
        step = np.linalg.solve((design * (each * p * (1 - p) + 1e-9)[:, None]).T @ design + prior, design.T @ (each * (p - target)) + prior @ theta)
        theta -= step if np.abs(step).max() < 5 else step * 5 / np.abs(step).max()
        if np.abs(step).max() < 1e-8:
            break
    return theta


def probability(margin: np.ndarray, a: float, c: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * margin + c, -35, 35)))


def held_back(label: np.ndarray, every: int = 4) -> np.ndarray:
    """True for every fourth row of each class: those that the calibration uses."""
    out = np.zeros(len(label), dtype=bool)
    for value in np.unique(label):
        out[np.flatnonzero(label == value)[::every]] = True
    return out
