"""Small numpy models shared by the classifiers: they are fitted on bounded samples on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Sparse:
    """Rows of a binary matrix: ``column[start[i]:start[i + 1]]`` are the ones of row i."""

    start: np.ndarray
    column: np.ndarray
    width: int

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    @classmethod
    def of(cls, rows: list[np.ndarray], width: int) -> Sparse:
        start = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        return cls(start, np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64), width)

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        return Sparse.of([self.column[self.start[i] : self.start[i + 1]] for i in rows], self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], minlength=len(self))

    def back(self, g: np.ndarray) -> np.ndarray:
        """The transposed product."""
        return np.bincount(self.column, g[self.row], minlength=self.width)


@dataclass
class Logistic:
    """Logistic regression on a sparse binary matrix and a few dense columns."""

    weight: np.ndarray
    dense: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: Sparse, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 300, rate: float = 0.5) -> Logistic:
        """Full-batch AdaGrad on weighted rows, from zero: the same rows give the same model."""
        if not len(y) or y.min() == y.max():  # nothing to tell apart: a constant
            return cls(np.zeros(x.width), np.zeros(extra.shape[1]), 40.0 if len(y) and y[0] else -40.0)
        n = max(float(weight.sum()), 1e-9)
        w, d, b = np.zeros(x.width), np.zeros(extra.shape[1]), 0.0
        sums = [np.full(x.width, 1e-8), np.full(extra.shape[1], 1e-8), 1e-8]
        for _ in range(steps):
            g = weight * (sigmoid(x.dot(w) + extra @ d + b) - y) / n
            grads = x.back(g) + l2 * w / n, extra.T @ g + l2 * d / n, float(g.sum())
            for i, one in enumerate(grads):
                sums[i] = sums[i] + one * one
            w = w - rate * grads[0] / np.sqrt(sums[0])
            d = d - rate * grads[1] / np.sqrt(sums[1])
            b = b - rate * grads[2] / float(np.sqrt(sums[2]))
        return cls(w, d, b)

    def predict(self, x: Sparse, extra: np.ndarray) -> np.ndarray:
        return sigmoid(x.dot(self.weight) + extra @ self.dense + self.bias)
