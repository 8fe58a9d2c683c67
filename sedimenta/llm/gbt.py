"""Histogram gradient-boosted trees for binary labels, on bounded samples.

Features are cut into at most 64 bins; trees grow level by level to a fixed
depth from histograms of gradients, and end as flat arrays: for every tree a
feature and a threshold per inner node and a value per leaf. A node that was
not split sends all rows left. Scoring moves all rows through all trees one
level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """``feature`` and ``threshold``: trees x inner nodes; ``value``: trees x leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def logit(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        out = np.full(len(x), self.base)
        tree = np.arange(trees)
        for at in range(0, len(x) if trees else 0, block):
            part = x[at : at + block]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                right = part[rows, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            out[at : at + block] += self.value[tree, node - inner].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: float = 2.0, weight: np.ndarray | None = None) -> Forest:
    """Logistic loss. Without rows of both classes the forest is a smoothed constant."""
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    w = np.ones(n) if weight is None else weight
    prior = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1.0)
    base = float(np.log(prior / (1 - prior)))
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Forest(feature[:0], threshold[:0], value[:0], base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    useful = [f for f in range(width) if codes[:, f].min() != codes[:, f].max()]
    flags = [f for f in useful if codes[:, f].max() == 1]  # two bins: their histograms are one product
    useful = [f for f in useful if codes[:, f].max() > 1]
    flag = codes[:, flags].astype(float)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width_now = 2**level - 1, 2**level
            best = np.zeros(width_now)
            where = np.zeros((width_now, 2), np.int64) - 1
            total_g, total_h = np.bincount(node, g, width_now), np.bincount(node, h, width_now)
            parent = total_g**2 / (total_h + l2)
            for f in useful:
                at, size = node * bins + codes[:, f], width_now * bins
                left_g = np.bincount(at, g, size).reshape(width_now, bins).cumsum(axis=1)
                left_h = np.bincount(at, h, size).reshape(width_now, bins).cumsum(axis=1)
                left_n = np.bincount(at, minlength=size).reshape(width_now, bins).cumsum(axis=1)
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - parent[:, None]
                gain[(left_n < min_rows) | (left_n[:, -1:] - left_n < min_rows)] = 0
                k = gain[:, :-1].argmax(axis=1)
                top = gain[np.arange(width_now), k]
                better = top > best + 1e-9
                best[better], where[better, 0], where[better, 1] = top[better], f, k[better]
            if flags:
                mine = (node == np.arange(width_now)[:, None]).astype(float)
                right_g, right_h, right_n = (mine * g) @ flag, (mine * h) @ flag, mine @ flag
                left_g, left_h, left_n = total_g[:, None] - right_g, total_h[:, None] - right_h, mine.sum(axis=1)[:, None] - right_n
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - parent[:, None]
                gain[(left_n < min_rows) | (right_n < min_rows)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width_now), k]
                better = top > best + 1e-9
                where[better, 0], where[better, 1] = np.array(flags)[k[better]], 0
            right = np.zeros(n, np.int64)
            for j in np.flatnonzero(where[:, 0] >= 0):
                f, k = where[j]
                feature[t, first + j], threshold[t, first + j] = f, edges[f][k]
                mine = node == j
                right[mine] = codes[mine, f] > k
            node = 2 * node + right
        leaf_g, leaf_h = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t] = -rate * leaf_g / (leaf_h + l2)
        score += value[t][node]
    return Forest(feature, threshold, value, base)
