"""Gradient-boosted trees for two classes over binned features (numpy)."""

from __future__ import annotations

import numpy as np

BINS = 32


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, weight: np.ndarray | None = None) -> dict:
    """Newton boosting on the logistic loss; each tree is complete to its depth, a level at a time."""
    n, f = x.shape
    weight = np.ones(n) if weight is None else weight
    # columns of 0 and 1 are summed by one product; the others by their bins
    flags = np.flatnonzero(((x == 0) | (x == 1)).all(0))
    others = np.setdiff1d(np.arange(f), flags)
    edges = {j: np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1]) for j in others}
    b = {j: np.searchsorted(edges[j], x[:, j], "right") for j in others}
    ones = np.ascontiguousarray(x[:, flags].T, np.float64)
    rows = np.arange(n)
    base = np.log((weight @ y + 1) / (weight @ (1 - y) + 1))
    s = np.full(n, base)
    out_feature, out_cut, out_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-s))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k, start = 2**level, 2**level - 1
            best = np.full(k, 1e-6)
            gt, ht = np.bincount(node, g, k)[:, None], np.bincount(node, h, k)[:, None]

            def offer(gain, hs, which, cuts):
                gain[(hs < 1) | (ht - hs < 1)] = 0  # noqa: B023
                at = gain.argmax(1)
                high = gain[np.arange(k), at]  # noqa: B023
                for q in np.flatnonzero(high > best):  # noqa: B023
                    best[q], feature[start + q], cut[start + q] = high[q], which[at[q]], cuts[at[q]]  # noqa: B023

            def gains(gs, hs):
                return gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)  # noqa: B023

            if len(flags):
                sums = np.zeros((n, 2 * k))
                sums[rows, node], sums[rows, k + node] = g, h
                sums = (ones @ sums).T
                offer(gains(sums[:k], sums[k:]), sums[k:], flags, np.ones(len(flags)))
            for j in others:
                key = node * BINS + b[j]
                gs = np.bincount(key, g, k * BINS).reshape(k, BINS).cumsum(1)[:, :-1]
                hs = np.bincount(key, h, k * BINS).reshape(k, BINS).cumsum(1)[:, :-1]
                offer(gains(gs, hs), hs, np.full(BINS, j), edges[j])
            node = node * 2 + (x[rows, feature[start + node]] >= cut[start + node])
        leaves = 2**depth
        leaf = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        s += leaf[node]
        out_feature.append(feature)
        out_cut.append(cut)
        out_leaf.append(leaf)
    return {"base": base, "depth": depth, "feature": np.array(out_feature), "cut": np.array(out_cut), "leaf": np.array(out_leaf)}


def predict(m: dict, x: np.ndarray) -> np.ndarray:
    rows, s = np.arange(len(x)), np.full(len(x), m["base"])
    for feature, cut, leaf in zip(m["feature"], m["cut"], m["leaf"]):
        node = np.zeros(len(x), np.int64)
        for level in range(m["depth"]):
            at = node + 2**level - 1
            node = node * 2 + (x[rows, feature[at]] >= cut[at])
        s += leaf[node]
    return 1 / (1 + np.exp(-s))
