"""Sparse multinomial logistic regression by follow-the-regularised-leader (McMahan et al., 2013).

Elastic net: L1 inside the FTRL-proximal update gives exact zeros, L2 adds to its denominator.
Rows are CSR arrays; minibatches in a seeded order; classes share no parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """CSR rows: row i has columns cols[start[i]:start[i+1]] with values vals[...]."""

    start: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, which: np.ndarray) -> Rows:
        n = np.diff(self.start)[which]
        start = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.start[:-1][which] - start[:-1], n) + np.arange(start[-1])
        return Rows(start, self.cols[at], self.vals[at])

    def with_column(self, column: int, values: np.ndarray) -> Rows:
        """One more entry in each row."""
        at = self.start[1:]
        return Rows(self.start + np.arange(len(self.start)), np.insert(self.cols, at, column), np.insert(self.vals, at, values))


def rows_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    n = np.cumsum([0, *(len(c) for c, _ in parts)])
    cat = lambda i, t: np.concatenate([p[i] for p in parts]).astype(t) if parts else np.empty(0, t)
    return Rows(n, cat(0, np.int64), cat(1, np.float64))


def logits(w: np.ndarray, bias: np.ndarray, x: Rows) -> np.ndarray:
    """w (columns, classes)."""
    out = np.zeros((len(x), w.shape[1]))
    full = np.flatnonzero(np.diff(x.start))
    for k in range(w.shape[1]):
        if len(full):
            out[full, k] = np.add.reduceat(w[x.cols, k] * x.vals, x.start[full])
    return out + bias


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: Rows, y: np.ndarray, columns: int, classes: int, *, epochs: int = 4, batch: int = 64, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (columns, classes) and biases. l1 and l2 are for one example; the sums grow with those seen."""
    z, n, w = (np.zeros((columns, classes), np.float32 if columns * classes > 1 << 22 else np.float64) for _ in range(3))
    bias, bias_n = np.zeros(classes), np.zeros(classes)
    rng, seen = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            r = x.take(at)
            g = softmax(logits(w, bias, r))
            g[np.arange(len(at)), y[at]] -= 1
            seen += len(at)
            cols, inv = np.unique(r.cols, return_inverse=True)
            per = np.repeat(g, np.diff(r.start), axis=0) * r.vals[:, None]
            grad = np.stack([np.bincount(inv, weights=per[:, k], minlength=len(cols)) for k in range(classes)], 1)
            n0 = n[cols]
            n1 = n0 + grad**2
            z[cols] += grad - (np.sqrt(n1) - np.sqrt(n0)) / alpha * w[cols]
            n[cols] = n1
            zz = z[cols]
            w[cols] = np.where(np.abs(zz) <= l1 * seen, 0.0, -(zz - np.sign(zz) * l1 * seen) / ((beta + np.sqrt(n1)) / alpha + l2 * seen))
            b = g.sum(0)
            bias_n += b**2
            bias -= alpha * b / (beta + np.sqrt(bias_n))
    return w, bias


def temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The T > 0 that gives softmax(s / T) the smallest log loss on y, by golden-section search over log T.

    Targets are smoothed as in Platt scaling (1999): the true class counts (n + 1) / (n + 2), the others share the
    rest. So a model without errors on y gets a finite T that grows with what y can show, not the end of the range.
    """
    n, k = s.shape
    if not n or k < 2:
        return 1.0
    miss = 1 / (n + 2)

    def loss(log_t: float) -> float:
        t = s / np.exp(log_t)
        t = t - t.max(1, keepdims=True)
        p = t - np.log(np.exp(t).sum(1, keepdims=True))
        own = p[np.arange(n), y]
        return float(-((1 - miss) * own + miss / (k - 1) * (p.sum(1) - own)).mean())

    a, b, r = np.log(1e-3), np.log(1e3), (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
