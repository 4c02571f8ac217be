"""Histogram gradient-boosted trees for a binary label, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    l2: float = 1.0
    least_rows: int = 10
    least_gain: float = 1e-3


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in one set of arrays. A leaf points to itself, so that a fixed number of steps ends in it."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all trees step down together for all rows."""
        rows = np.nan_to_num(np.asarray(rows, np.float64))
        if not len(self.roots) or not len(rows):
            return np.full(len(rows), 1 / (1 + np.exp(-self.base)))
        node = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            up = rows[at, self.feature[node]] > self.threshold[node]
            node = np.where(up, self.right[node], self.left[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between bins: midpoints of neighbouring quantiles."""
    values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def train(rows: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Forest:
    """Boosting on the logistic loss; each level of a tree is one histogram of gradients by node, feature and bin.

    With one label only, or no rows, the forest has no trees and scores every row with the labels' (smoothed) share.
    """
    rows, labels = np.nan_to_num(np.asarray(rows, np.float64)), np.asarray(labels, np.float64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {name: [] for name in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node() -> int:
        at = len(nodes["value"])
        for name, start in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", 0.0)):
            nodes[name].append(start)
        return at

    def forest() -> Forest:
        kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
        arrays = [np.array(values, kind) for values, kind in zip(nodes.values(), kinds)]
        return Forest(base, settings.depth, np.array(roots, np.int64), *arrays)

    if len(labels) == 0 or labels.min() == labels.max():
        return forest()
    count, width = rows.shape
    edges = [_edges(rows[:, f], settings.bins) for f in range(width)]
    size = max(map(len, edges)) + 1
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    offsets = np.arange(width) * size
    score = np.full(count, base)
    for _ in range(settings.trees):
        chance = 1 / (1 + np.exp(-score))
        gradient, weight = labels - chance, chance * (1 - chance)
        roots.append(node())
        place = np.full(count, roots[-1])
        open_nodes = [roots[-1]]
        for _ in range(settings.depth):
            if not open_nodes:
                break
            slot_of = np.full(len(nodes["value"]), -1)
            slot_of[open_nodes] = np.arange(len(open_nodes))
            slot = slot_of[place]
            live = np.flatnonzero(slot >= 0)
            cells = (slot[live, None] * (width * size) + offsets + binned[live]).ravel()
            shape = (len(open_nodes), width, size)
            g, h, n = (
                np.bincount(cells, None if v is None else np.repeat(v[live], width), np.prod(shape)).reshape(shape)
                .cumsum(axis=2) for v in (gradient, weight, None)
            )
            gain = sum(
                a**2 / (b + settings.l2) for a, b in ((g, h), (g[..., -1:] - g, h[..., -1:] - h))
            ) - g[..., -1:] ** 2 / (h[..., -1:] + settings.l2)
            gain[(n < settings.least_rows) | (n[..., -1:] - n < settings.least_rows)] = 0
            best = gain.reshape(len(open_nodes), -1).argmax(axis=1)
            grown = []
            for k, parent in enumerate(open_nodes):
                f, b = divmod(int(best[k]), size)
                if gain[k, f, b] <= settings.least_gain:
                    continue
                nodes["feature"][parent], nodes["threshold"][parent] = f, edges[f][b]
                children = node(), node()
                nodes["left"][parent], nodes["right"][parent] = children
                mine = live[slot[live] == k]
                place[mine] = np.where(binned[mine, f] > b, children[1], children[0])
                grown.extend(children)
            open_nodes = grown
        total_g = np.bincount(place, gradient, len(nodes["value"]))
        total_h = np.bincount(place, weight, len(nodes["value"]))
        for leaf in np.unique(place):
            nodes["value"][leaf] = settings.rate * total_g[leaf] / (total_h[leaf] + settings.l2)
        score += np.array(nodes["value"])[place]
    return forest()
