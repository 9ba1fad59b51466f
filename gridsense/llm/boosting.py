"""Gradient-boosted trees with monotonic constraints, fitted on a bounded sample and flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in a row; a leaf points to itself, so that every row takes ``depth`` steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds for rows of features."""
        total = np.full(len(rows), self.start)
        each = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                at = np.where(rows[each, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total


def fit(rows: np.ndarray, target: np.ndarray, directions: list[int], trees: int = 40, depth: int = 3,
        rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting on binned features. ``directions``: 1 rising, -1 falling, 0 free, for each feature.

    A split on a constrained feature must order its children's values, and the middle between them bounds
    everything below either child; each tree, and thus their sum, is then monotonic in that feature.
    """
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T, strict=True)], axis=1)
    share = float(np.clip(target.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(rows), start)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value * rate])
        return len(nodes) - 1

    def best_split(held: np.ndarray, slope: np.ndarray, bend: np.ndarray, low: float, high: float):
        total, weight = slope[held].sum(), bend[held].sum()
        whole = total * total / (weight + ridge)
        best = (1e-6, 0, 0, 0.0, 0.0)
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            s = np.cumsum(np.bincount(binned[held, f], slope[held], len(edge) + 1))[:-1]
            b = np.cumsum(np.bincount(binned[held, f], bend[held], len(edge) + 1))[:-1]
            a, c = -s / (b + ridge), -(total - s) / (weight - b + ridge)
            a, c = np.clip(a, low, high), np.clip(c, low, high)
            gain = s * s / (b + ridge) + (total - s) ** 2 / (weight - b + ridge) - whole
            gain[(b < least) | (weight - b < least) | (directions[f] * (c - a) < 0)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k, a[k], c[k])
        return best

    def grow(held: np.ndarray, slope: np.ndarray, bend: np.ndarray, level: int, value: float, low: float, high: float) -> int:
        gain, f, k, a, c = best_split(held, slope, bend, low, high) if level < depth else (0, 0, 0, 0, 0)
        if gain <= 1e-6:
            at = leaf(value)
            margin[held] += value * rate
            return at
        at = len(nodes)
        nodes.append([f, edges[f][k], 0, 0, 0.0])
        goes_left = binned[held, f] <= k
        middle = (a + c) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(directions[f], ((low, high),) * 2)
        nodes[at][2] = grow(held[goes_left], slope, bend, level + 1, a, *bounds[0])
        nodes[at][3] = grow(held[~goes_left], slope, bend, level + 1, c, *bounds[1])
        return at

    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = chance - target, np.maximum(chance * (1 - chance), 1e-9)
        everyone = np.arange(len(rows))
        value = -slope.sum() / (bend.sum() + ridge)
        roots.append(grow(everyone, slope, bend, 0, value, -np.inf, np.inf))
    columns = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Trees(np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(columns, kinds, strict=True)), depth, start)
