"""Linear classifiers over hashed features, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 18
#: Rows of a mini-batch.
BATCH = 64


#: Names that begin so have places of their own, from 1 << BITS on.
MARK = "\0"


def indices(names: list[str]) -> np.ndarray:
    """Distinct hashed places of the features named."""
    return np.unique(np.array([(xxhash.xxh64_intdigest(x) & ((1 << BITS) - 1)) + ((x[:1] == MARK) << BITS) for x in names], dtype=np.int64))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class LinearModel:
    """One logistic regression per label over the same binary features. A row of features must not be empty.

    marked: the label that marked features speak about; no other is told by them.
    """

    def __init__(self, labels: int, marked: int | None = None):
        self.w = np.zeros((1 << (BITS + (marked is not None)), labels), dtype=np.float32)
        self.others = [k for k in range(labels) if k != marked]

    def fit(self, rows: list[np.ndarray], y: np.ndarray, use: np.ndarray, seed: int, epochs: int = 4) -> None:
        """Adagrad with mini-batches; use: 0 where a row says nothing about a label, else 1."""
        if not len(rows):
            return
        rng = np.random.default_rng(seed)
        # Only the places that occur take part; rows lie one after the other.
        sizes = np.array([len(r) for r in rows])
        known, flat = np.unique(np.concatenate(rows), return_inverse=True)
        first = np.cumsum(sizes) - sizes
        w = self.w[known].astype(np.float64)
        g2 = np.full_like(w, 1e-3)
        spoken = np.ones_like(w)
        if len(self.w) > 1 << BITS:
            spoken[np.ix_(known >= 1 << BITS, self.others)] = 0
        labels = w.shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                n = sizes[batch]
                starts = np.cumsum(n) - n
                at = flat[np.repeat(first[batch] - starts, n) + np.arange(n.sum())]
                p = _logistic(np.add.reduceat(w[at], starts, axis=0))
                error = np.repeat((p - y[batch]) * use[batch], n, axis=0)
                ids, inverse = np.unique(at, return_inverse=True)
                g = np.stack([np.bincount(inverse, error[:, j], len(ids)) for j in range(labels)], axis=1)
                g = (g / len(batch) + 1e-6 * w[ids]) * spoken[ids]
                g2[ids] += g * g
                w[ids] -= 0.3 * g / np.sqrt(g2[ids])
        self.w[known] = w

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros((0, self.w.shape[1]))
        starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
        return _logistic(np.add.reduceat(self.w[np.concatenate(rows)], starts, axis=0))
