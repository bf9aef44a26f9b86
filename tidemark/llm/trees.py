"""Small tree and linear learners in numpy, fitted on the driver over bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Arrays by node: a row goes right when x[feature] > threshold; leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for values, start in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            values.append(start)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while (inner := feature[at] >= 0).any():
            on = rows[inner]
            node = at[on]
            at[on] = np.where(x[on, feature[node]] > threshold[node], right[node], left[node])
        return value[at]

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conjunction that leads to each node but the root: (feature, above, threshold)."""
        found = []
        todo: list[tuple[int, tuple]] = [(0, ())]
        while todo:
            node, path = todo.pop()
            if path:
                found.append(path)
            if self.feature[node] >= 0:
                test = (self.feature[node], self.threshold[node])
                todo.append((self.left[node], (*path, (test[0], False, test[1]))))
                todo.append((self.right[node], (*path, (test[0], True, test[1]))))
        return found


@dataclass
class Boosted:
    start: float
    trees: list[Tree]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if len(x):
            for tree in self.trees:
                out += tree.predict(x)
        return out


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 50, depth: int = 3, rate: float = 0.25, bins: int = 32, least: float = 2.0) -> Boosted:
    """Gradient-boosted trees for 0/1 targets: logistic loss, second-order gains, quantile bins."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    coded = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = coded + np.arange(m) * bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), [])
    logit = np.full(n, model.start)
    for _ in range(n_trees):
        p = sigmoid(logit)
        slope, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        tree = Tree()
        todo = [(tree.add(), np.arange(n), 0)]
        while todo:
            node, rows, level = todo.pop()
            g, h = slope[rows].sum(), weight[rows].sum()
            tree.value[node] = float(rate * g / (h + 1.0))
            logit_add = tree.value[node]
            if level < depth and h >= 2 * least:
                keys = flat[rows].ravel()
                gs = np.bincount(keys, np.repeat(slope[rows], m), m * bins).reshape(m, bins).cumsum(1)[:, :-1]
                hs = np.bincount(keys, np.repeat(weight[rows], m), m * bins).reshape(m, bins).cumsum(1)[:, :-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
                gain[(hs < least) | (h - hs < least)] = 0
                f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, cut] > 1e-3 and cut < len(edges[f]):
                    above = coded[rows, f] > cut
                    tree.feature[node], tree.threshold[node] = int(f), float(edges[f][cut])
                    tree.left[node], tree.right[node] = tree.add(), tree.add()
                    todo.append((tree.left[node], rows[~above], level + 1))
                    todo.append((tree.right[node], rows[above], level + 1))
                    continue
            logit[rows] += logit_add
        model.trees.append(tree)
    return model


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an l1-penalised logistic regression, by accelerated proximal steps."""
    n, m = x.shape
    a = np.hstack([np.ones((n, 1)), x])
    size = np.linalg.norm(a, 2) ** 2 / (4 * n) + 1e-9
    w = np.zeros(m + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        slope = a.T @ (sigmoid(a @ ahead) - y) / n
        new = ahead - slope / size
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / size, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def ridge_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    hold = np.eye(a.shape[1]) * penalty
    hold[0, 0] = 1e-3
    for _ in range(steps):
        p = sigmoid(a @ w)
        h = a.T @ (a * (p * (1 - p))[:, None]) + hold
        w = w + np.linalg.solve(h, a.T @ (y - p) - hold @ w)
    return w
