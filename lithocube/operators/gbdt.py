"""Gradient-boosted regression trees on histograms, in numpy, small enough to run inside a grouped pandas function.

Leaf-wise growth as published for histogram boosting: features are cut into quantile bins once; a leaf's best split is
found from sums per bin; the leaf with the greatest gain is split next.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class Params:
    learning_rate: float = 0.1
    max_bin: int = 128
    max_depth: int = 10
    num_leaves: int = 20
    rounds: int = 400
    min_data: int = 20
    early_stop: int = 30
    ridge: float = 0.0

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return self.value[node]
            rows = np.flatnonzero(inner)
            n = node[rows]
            v = x[rows, f[rows]]
            # Missing values go left.
            node[rows] = np.where(~(v > self.threshold[n]), self.left[n], self.right[n])


#: Parts of a tree and their kinds.
TREE = {"feature": np.int64, "threshold": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}


@dataclass
class Model:
    base: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x)
        return out

    def dumps(self) -> str:
        """The model as JSON text; numbers are written so that they are read back exactly."""
        return json.dumps({"base": float(self.base), "trees": [{k: getattr(t, k).tolist() for k in TREE} for t in self.trees]})

    @staticmethod
    def loads(text: str) -> Model:
        d = json.loads(text)
        return Model(d["base"], [Tree(**{k: np.array(t[k], kind) for k, kind in TREE.items()}) for t in d["trees"]])


def _bins(x: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers (0 for missing) and upper edges per feature."""
    codes, edges = np.zeros(x.shape, np.int64), []
    for j in range(x.shape[1]):
        v = x[:, j]
        seen = np.unique(v[np.isfinite(v)])
        if len(seen) > most:
            seen = np.unique(np.quantile(v[np.isfinite(v)], np.linspace(0, 1, most + 1)[1:-1], method="nearest"))
            e = seen
        else:
            e = (seen[1:] + seen[:-1]) / 2
        edges.append(e)
        codes[:, j] = np.where(np.isfinite(v), np.searchsorted(e, v, side="left") + 1, 0)
    return codes, edges


def _best(codes: np.ndarray, g: np.ndarray, rows: np.ndarray, n_bins: int, p: Params) -> tuple[float, int, int]:
    """(gain, feature, last bin on the left) of a leaf's best split."""
    k = codes.shape[1]
    flat = (codes[rows] + np.arange(k) * n_bins).ravel()
    count = np.bincount(flat, minlength=k * n_bins).reshape(k, n_bins).cumsum(axis=1)
    total = np.bincount(flat, np.repeat(g[rows], k), k * n_bins).reshape(k, n_bins).cumsum(axis=1)
    n, s = count[:, -1:], total[:, -1:]
    right = n - count
    ok = (count >= p.min_data) & (right >= p.min_data)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = total**2 / (count + p.ridge) + (s - total) ** 2 / (right + p.ridge) - s**2 / (n + p.ridge)
    gain = np.where(ok, gain, -np.inf)
    at = int(np.argmax(gain))
    return float(gain.flat[at]), at // n_bins, at % n_bins


def _grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, n_bins: int, p: Params) -> tuple[Tree, np.ndarray]:
    feature, threshold, left, right, value = [-1], [0.0], [0], [0], [float(g.mean()) * p.learning_rate]
    leaf = np.zeros(len(g), np.int64)
    open_ = [(0, np.arange(len(g)), 0, _best(codes, g, np.arange(len(g)), n_bins, p))]
    while open_ and len(feature) < 2 * p.num_leaves - 1:
        i = max(range(len(open_)), key=lambda k: open_[k][3][0])
        node, rows, depth, (gain, f, b) = open_.pop(i)
        if not gain > 1e-12:
            break
        goes = codes[rows, f] <= b
        feature[node], threshold[node] = f, float(edges[f][b - 1]) if b >= 1 else -np.inf
        for side, part in ((left, rows[goes]), (right, rows[~goes])):
            side[node] = len(feature)
            feature.append(-1), threshold.append(0.0), left.append(0), right.append(0)
            value.append(float(g[part].sum() / (len(part) + p.ridge)) * p.learning_rate)
            leaf[part] = len(feature) - 1
            if depth + 1 < p.max_depth and len(part) >= 2 * p.min_data:
                open_.append((len(feature) - 1, part, depth + 1, _best(codes, g, part, n_bins, p)))
    tree = Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))
    return tree, tree.value[leaf]


def train(x: np.ndarray, y: np.ndarray, p: Params = Params(), xv: np.ndarray | None = None, yv: np.ndarray | None = None, start: Model | None = None) -> Model:
    """Boosted trees for squared error, from the mean of `y` or, for incremental learning, from the model `start`.

    With validation data, boosting ends when their mean absolute error has not fallen for `early_stop` rounds; trees
    after the best round are dropped. Missing features are a bin of their own.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    model = Model(float(y.mean()), []) if start is None else Model(start.base, list(start.trees))
    held = len(model.trees)
    codes, edges = _bins(x, p.max_bin)
    n_bins = max([len(e) for e in edges] or [0]) + 2
    now = model.predict(x)
    check = None if xv is None or not len(xv) else model.predict(xv)
    best, best_at = (np.inf, held) if check is None else (float(np.abs(np.asarray(yv, float) - check).mean()), held)
    for _ in range(p.rounds):
        tree, step = _grow(codes, edges, y - now, n_bins, p)
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
        now = now + step
        if check is not None:
            check = check + tree.predict(np.asarray(xv, float))
            mae = float(np.abs(np.asarray(yv, float) - check).mean())
            if mae < best - 1e-12:
                best, best_at = mae, len(model.trees)
            elif len(model.trees) - best_at >= p.early_stop:
                break
    if check is not None:
        model.trees = model.trees[: max(best_at, held)]
    return model
