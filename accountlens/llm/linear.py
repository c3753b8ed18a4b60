"""Small regularised linear classifiers, fitted in one task on a sample of bounded size."""

from __future__ import annotations

import numpy as np

#: Rows that are copied at a time.
_ROWS = 512


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150,
    more: np.ndarray | None = None, rows: np.ndarray | None = None,
) -> np.ndarray:
    """Weights, the intercept last; accelerated gradient steps of fixed number, so reruns agree.

    Columns are scaled to equal size while fitting, so that rare features are learnt as fast. With one class only the weights are 0 and the intercept says so.
    ``more`` are columns to the right of ``x``; only ``rows`` (a mask) are fitted on, if given. One copy of
    the matrix is made, whatever is asked for.
    """
    rows = np.flatnonzero(np.ones(len(x), bool) if rows is None else rows)
    more = np.zeros((len(x), 0), x.dtype) if more is None else more
    y = y[rows]
    n, d = len(rows), x.shape[1] + more.shape[1]
    w = np.zeros(d + 1, np.float32)
    rate = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    w[-1] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return w
    own = np.empty((n, d + 1), x.dtype)

    def fill() -> None:
        for start in range(0, n, _ROWS):
            taken, to = rows[start : start + _ROWS], own[start : start + _ROWS]
            to[:, : x.shape[1]], to[:, x.shape[1] : d], to[:, d] = x[taken], more[taken], 1

    fill()
    np.square(own[:, :d], out=own[:, :d])
    scale = 1 / np.sqrt(own[:, :d].mean(axis=0) + 1e-6)
    fill()
    own[:, :d] *= scale
    # the largest eigenvalue bounds the curvature; in doubles, so a slice at a time
    v = np.ones(d + 1) / np.sqrt(d + 1)
    slices = [slice(start, start + _ROWS) for start in range(0, n, _ROWS)]
    for _ in range(12):
        u = sum(own[s].T @ (own[s] @ v) for s in slices)
        v = u / np.linalg.norm(u)
    step = 1 / (0.25 * 1.1 * float(sum(np.linalg.norm(own[s] @ v) ** 2 for s in slices)) / n + penalty)
    before = w.copy()
    for k in range(steps):
        ahead = w + np.float32(k / (k + 3)) * (w - before)
        gradient = own.T @ (sigmoid(own @ ahead) - y).astype(np.float32) / n
        gradient[:-1] += penalty * ahead[:-1]
        before, w = w, (ahead - step * gradient).astype(np.float32)
    w[:-1] *= scale
    return w


def predict_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights (features + 1, classes) of multinomial logistic regression."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    target = np.eye(classes)[y]
    step = 1 / (0.5 * float(np.linalg.norm(x, 2) ** 2) / len(x) + penalty)
    w = before = np.zeros((x.shape[1], classes))
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - before)
        gradient = x.T @ (softmax(x @ ahead) - target) / len(x) + penalty * ahead
        before, w = w, ahead - step * gradient
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
