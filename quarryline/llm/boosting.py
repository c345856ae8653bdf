"""Small gradient-boosted trees: fitted in numpy, applied as one column expression of a size that does not grow with them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Levels of inner nodes of a tree.
DEPTH = 3


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(x, residual, weight, rows, depth, least):
    """A tree by variance gain; leaves hold one Newton step."""
    leaf = float(residual[rows].sum() / (weight[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best = (1e-6, None, None)
    g, h = residual[rows], weight[rows]
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[rows, j], kind="stable")
        v, cg, ch = x[rows, j][order], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.nonzero(v[1:] > v[:-1])[0]
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            gain = cg[cut] ** 2 / (ch[cut] + 1.0) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + 1.0) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] is None:
        return leaf
    left = x[rows, best[1]] <= best[2]
    return (best[1], best[2], _grow(x, residual, weight, rows[left], depth - 1, least), _grow(x, residual, weight, rows[~left], depth - 1, least))


def _apply(tree, x):
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _apply(low, x), _apply(high, x))


@dataclass
class Boosted:
    """Logistic boosting; scale and shift are the calibration (Platt), threshold the smallest accepted probability."""

    names: tuple[str, ...]
    trees: list = field(default_factory=list)
    rate: float = 0.3
    start: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def fit(self, x, y, rounds=24, depth=DEPTH, least=8):
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        raw = np.full(len(y), self.start)
        for _ in range(rounds):
            p = sigmoid(raw)
            tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, least)
            self.trees.append(tree)
            raw = raw + self.rate * _apply(tree, x)
        return self

    def raw(self, x):
        return self.start + self.rate * sum(_apply(t, x) for t in self.trees)

    def calibrate(self, x, y, precision):
        """Platt scaling on rows that were not fitted; then the smallest threshold that reaches the precision there."""
        raw = self.raw(x)
        for _ in range(200):
            e = sigmoid(self.scale * raw + self.shift) - y
            self.scale -= 0.1 * float((e * raw).mean())
            self.shift -= 0.1 * float(e.mean())
        p = sigmoid(self.scale * raw + self.shift)
        for cut in np.sort(np.unique(np.concatenate([p, [0.5]]))):
            if cut >= 0.5 and y[p >= cut].mean() >= precision:
                self.threshold = float(cut) - 1e-9
                break
        return self

    def probability(self, x):
        return sigmoid(self.scale * self.raw(x) + self.shift)

    def nodes(self) -> list[dict]:
        """Each tree as a full one of DEPTH levels: feature (j) and cut (c) of the inner nodes in heap order, values (v) of the leaves."""
        out = []
        for tree in self.trees:
            level, j, c = [tree], [], []
            for _ in range(DEPTH):
                below = []
                for node in level:
                    leaf = isinstance(node, float)
                    j.append(0 if leaf else node[0])
                    c.append(0.0 if leaf else node[1])
                    below += [node, node] if leaf else [node[2], node[3]]
                level = below
            out.append({"j": j, "c": c, "v": level})
        return out

    def column(self, feature: dict[str, Column]) -> Column:
        """The calibrated probability as an expression over feature columns: the trees are one literal, walked level by level."""
        trees = F.from_json(F.lit(json.dumps(self.nodes())), "array<struct<j:array<int>,c:array<double>,v:array<double>>>")
        step = lambda f, t: lambda n, _: 2 * n + F.when(F.get(f, F.get(t["j"], n)) <= F.get(t["c"], n), 1).otherwise(2)
        leaf = lambda f, t: F.get(t["v"], F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), step(f, t)) - ((1 << DEPTH) - 1))
        walk = lambda f: F.aggregate(trees, F.lit(self.start), lambda total, t: total + F.lit(self.rate) * leaf(f, t))
        total = F.transform(F.array(F.array(*(feature[k] for k in self.names))), walk)[0]
        return 1 / (1 + F.exp(-(F.lit(self.scale) * total + F.lit(self.shift))))
