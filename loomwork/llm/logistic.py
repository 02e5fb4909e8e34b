"""Logistic regression on hashed features of a bounded number of rows, with Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LogisticModel:
    """weights per bucket, bias, and the calibration p = sigmoid(a * margin + b)."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * margin + self.b)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


#: Rows whose features are worked on at a time.
CHUNK = 128


class _Rows:
    """Sparse rows, none of them empty, in chunks."""

    def __init__(self, rows):
        self.chunks = []
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            sizes = np.array([len(i) for i, _ in part])
            self.chunks.append((at, np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes, np.concatenate([i for i, _ in part]), np.concatenate([v for _, v in part])))

    def margins(self, w):
        return np.concatenate([np.add.reduceat(val * w[idx], starts) for _, starts, _, idx, val in self.chunks])

    def gradient(self, r, dims):
        g = np.zeros(dims)
        for at, _, sizes, idx, val in self.chunks:
            g += np.bincount(idx, weights=val * np.repeat(r[at : at + len(sizes)], sizes), minlength=dims)
        return g


def _descend(rows, y, weight, dims, rounds, l2, rate):
    """Full-batch Adam; deterministic."""
    w, bias = np.zeros(dims), 0.0
    m, v, mb, vb = np.zeros(dims), np.zeros(dims), 0.0, 0.0
    for t in range(1, rounds + 1):
        r = (sigmoid(rows.margins(w) + bias) - y) * weight
        g = rows.gradient(r, dims) / weight.sum() + l2 * w
        gb = r.sum() / weight.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        bias -= step * mb / (np.sqrt(vb) + 1e-8)
    return w, bias


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], dims: int, rounds: int = 60, l2: float = 1e-4, rate: float = 0.1, held: np.ndarray | None = None) -> LogisticModel | None:
    """rows: (label, buckets, values), each with a feature at least. Rows that held marks, every fourth one unless given, calibrate.
    None if one class is missing."""
    y = np.array([r[0] for r in rows], dtype=float)
    held = np.arange(len(rows)) % 4 == 3 if held is None else held.copy()
    if len(set(y[~held])) < 2:
        held[:] = False
    if len(set(y)) < 2:
        return None

    fitted = _Rows([r[1:] for r, k in zip(rows, held, strict=True) if not k])
    share = y[~held].mean()
    weight = np.where(y[~held] == 1, 0.5 / share, 0.5 / (1 - share))
    w, bias = _descend(fitted, y[~held], weight, dims, rounds, l2, rate)
    model = LogisticModel(w, bias)
    if len(set(y[held])) == 2:
        margin = _Rows([r[1:] for r, k in zip(rows, held, strict=True) if k]).margins(w) + bias
        spread = margin.std() or 1.0
        # Platt's targets keep the slope finite when the classes are separable.
        up, down = y[held].sum(), (1 - y[held]).sum()
        target = np.where(y[held] == 1, (up + 1) / (up + 2), 1 / (down + 2))
        one = _Rows([(np.zeros(1, np.int64), np.array([x])) for x in margin / spread])
        a, b = _descend(one, target, np.ones(len(margin)), 1, 400, 0.0, 0.05)
        model.a, model.b = max(float(a[0]) / spread, 1e-6), b
    return model
