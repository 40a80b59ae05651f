"""Small linear models in numpy for bounded samples, and byte-level text features for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from eventloom.llm.texthash import BLANK, LETTER, byte_class

#: Groups of bytes whose shares describe the look of a text or line.
LOOKS = (
    byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    byte_class("0123456789"),
    byte_class(".,;:'\"()-?"),
    byte_class("!"),
    byte_class("|"),
    byte_class("#$%&*+=@^_~<>{}[]\\/`"),
    BLANK,
    np.arange(256) >= 128,
)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 8) -> np.ndarray:
    """Weights (the last one is the constant) by Newton's method on the penalised likelihood."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def settled(p: np.ndarray) -> np.ndarray:
    """Probabilities to twelve digits: the last bits of a matrix product depend on the rows it is computed with, and equal texts must get equal results."""
    return np.round(p, 12)


def predict_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def fit_softmax(x: np.ndarray, y: np.ndarray, kinds: int, l2: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """(features + 1, kinds) weights by accelerated gradient descent; x is standardised by the caller."""
    x = np.column_stack((x, np.ones(len(x))))
    hot = np.eye(kinds)[y]
    w = np.zeros((x.shape[1], kinds))
    ahead, rate = w.copy(), 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + l2)
    for k in range(rounds):
        grad = x.T @ (softmax(x @ ahead) - hot) / len(x) + l2 * ahead
        new = ahead - rate * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def looks(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For every stretch [begin, end) of bytes: shares of the byte groups, mean word length and logarithm of the length."""
    size = np.maximum(end - begin, 1)
    columns = []
    for group in LOOKS:
        total = np.concatenate(([0], np.cumsum(group[data])))
        columns.append((total[end] - total[begin]) / size)
    inside = LETTER[data]
    starts = np.concatenate(([0], np.cumsum(inside & ~np.concatenate(([False], inside[:-1])))))
    letters = np.concatenate(([0], np.cumsum(inside)))
    words = np.maximum(starts[end] - starts[begin], 1)
    columns += [np.minimum((letters[end] - letters[begin]) / words, 40) / 10, np.log1p(end - begin) / 8]
    return np.column_stack(columns)


def as_texts(column: pa.Array) -> pa.Array:
    return column.fill_null("")
