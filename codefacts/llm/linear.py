"""Linear support vector machines on small dense samples (numpy, on the driver, bounded by the sample's documented size)."""

from __future__ import annotations

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised squared-hinge SVM; y is -1 or 1, both classes count alike."""
    d = x.shape[1]
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    x = x.astype(np.float32, copy=False)
    lipschitz = 1 + 2 * _largest(x, share)
    w = step = np.zeros(d + 1)
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ step[:-1].astype(np.float32) + step[-1]))
        pull = 2 * share * y * slack
        grad = np.append(step[:-1] - pull.astype(np.float32) @ x, -pull.sum())
        new = step - grad / lipschitz
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        step = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def _largest(x: np.ndarray, weight: np.ndarray) -> float:
    """The largest eigenvalue of the weighted products of the columns of x and of a column of ones (the bias)."""
    v = np.ones(x.shape[1] + 1) / (x.shape[1] + 1) ** 0.5
    norm = 1.0
    for _ in range(20):
        pull = weight * (x @ v[:-1].astype(np.float32) + v[-1])
        v = np.append(pull.astype(np.float32) @ x, pull.sum())
        norm = float(np.linalg.norm(v)) or 1.0
        v = v / norm
    return norm


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), by Newton steps with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margin, g.sum()]) + np.array([1e-3 * a, 0])
        hess = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    return float(a), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
