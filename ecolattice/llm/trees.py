"""Gradient-boosted regression trees for the logistic loss, in numpy, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    """A split (feature <= cut goes left) or a leaf (feature -1)."""

    feature: int = -1
    cut: float = 0.0
    value: float = 0.0
    left: Node | None = None
    right: Node | None = None


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate cuts of every column: midpoints between its quantiles."""
    out = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, ridge: float) -> Node:
    """A tree that fits -g/h on the given rows."""
    gs, hs = g[rows].sum(), h[rows].sum()
    leaf = Node(value=float(-gs / (hs + ridge)))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best = (1e-6, -1, 0)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        b = binned[rows, f]
        gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
        hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
        gain[(nl < least) | (len(rows) - nl < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] < 0:
        return leaf
    _, f, k = best
    goes = binned[rows, f] <= k
    leaf.feature, leaf.cut = f, float(cuts[f][k])
    leaf.left = grow(binned, cuts, g, h, rows[goes], depth - 1, least, ridge)
    leaf.right = grow(binned, cuts, g, h, rows[~goes], depth - 1, least, ridge)
    return leaf


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    goes = x[:, node.feature] <= node.cut
    return np.where(goes, predict(node.left, x), predict(node.right, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10, subsample: float = 1.0, seed: int = 1) -> tuple[float, list[Node]]:
    """(start, trees) of a boosted logistic model; leaf values are already scaled by the rate."""
    rnd = np.random.default_rng(seed)
    cuts = cuts_of(x, bins)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rnd.random(len(y)) < subsample) if subsample < 1 else np.arange(len(y))
        tree = grow(binned, cuts, prob - y, prob * (1 - prob), rows, depth, least, 1.0)
        _scale(tree, rate)
        trees.append(tree)
        margin = margin + predict(tree, x)
    return start, trees


def _scale(node: Node, rate: float) -> None:
    node.value *= rate
    for part in (node.left, node.right):
        if part:
            _scale(part, rate)


def paths(node: Node, so_far: tuple = ()) -> list[tuple]:
    """All paths from the root to any node but the root, as tuples of (feature, is_at_most, cut)."""
    if node.feature < 0:
        return []
    out = []
    for part, low in ((node.left, True), (node.right, False)):
        path = (*so_far, (node.feature, low, node.cut))
        out += [path, *paths(part, path)]
    return out
