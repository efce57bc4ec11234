"""Gradient-boosted trees with logistic loss on binned features; they score NumPy rows or become one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1. Values below the cut go left."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)


@dataclass
class Forest:
    names: list[str]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of x."""
        out = np.full(len(x), self.base)
        for t in self.trees:
            feature, cut, left, right, value = (np.array(v) for v in (t.feature, t.cut, t.left, t.right, t.value))
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] < cut[node], left[node], right[node])
            out += value[at]
        return out

    def sql(self) -> str:
        """The log-odds as SQL over columns called by the features' names."""

        def node(t: Tree, k: int) -> str:
            if t.feature[k] < 0:
                return f"{float(t.value[k])!r}D"
            return f"(CASE WHEN {self.names[t.feature[k]]} < {float(t.cut[k])!r}D THEN {node(t, t.left[k])} ELSE {node(t, t.right[k])} END)"

        return " + ".join([f"{self.base!r}D", *(node(t, 0) for t in self.trees)])


def fit(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 2) -> Forest:
    """Learns a forest; deterministic. Without rows of both labels it is the smoothed prior alone."""
    share = (y.sum() + 1) / (len(y) + 2)
    forest = Forest(names, float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return forest
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS, method="higher")) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    z = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        t = Tree()

        def grow(rows: np.ndarray, left_over: int, t=t, g=g, h=h) -> int:
            me = len(t.feature)
            gs, hs = g[rows].sum(), h[rows].sum()
            for col, v in ((t.feature, -1), (t.cut, 0.0), (t.left, -1), (t.right, -1), (t.value, float(rate * gs / (hs + ridge)))):
                col.append(v)
            best = (1e-6, -1, 0)
            if left_over and len(rows) >= 2 * least:
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = cells[k][rows]
                    n = len(e) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(c, w, n))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    j = int(np.argmax(gain))
                    if gain[j] > best[0]:
                        best = (float(gain[j]), k, j)
            if best[1] >= 0:
                _, k, j = best
                goes = cells[k][rows] <= j
                t.feature[me], t.cut[me] = k, float(edges[k][j])
                t.left[me] = grow(rows[goes], left_over - 1)
                t.right[me] = grow(rows[~goes], left_over - 1)
            return me

        grow(np.arange(len(y)), depth)
        forest.trees.append(t)
        z += Forest(names, 0.0, [t]).raw(x)
    return forest
