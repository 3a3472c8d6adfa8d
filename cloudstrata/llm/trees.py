"""Gradient-boosted trees on dense features with logistic loss, and isotonic calibration. NumPy only; fitted on bounded samples."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth over histogram bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 6, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        # a feature that is zero nearly everywhere has few quantiles: its other values get edges of their own
        edges = [np.unique(np.concatenate([e, np.quantile(v, np.linspace(0, 1, 12)) - 1e-9])) if len(v := x[x[:, j] != np.median(x[:, j]), j]) else e for j, e in enumerate(edges)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], 1)
        width = 1 + max(len(e) for e in edges)
        p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.edge = np.full((self.trees, inner), np.inf)
        self.value = np.zeros((self.trees, leaves))
        score = np.full(n, self.base)
        for t in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(n, np.int64)
            for d in range(self.depth):
                for i in range(2**d):
                    rows = np.flatnonzero(node == i)
                    best = self._split(binned[rows], g[rows], h[rows], width, edges) if len(rows) >= 2 * self.least else None
                    if best is None:
                        node[rows] = 2 * i
                        continue
                    j, b = best
                    at = 2**d - 1 + i
                    self.feature[t, at], self.edge[t, at] = j, edges[j][b]
                    node[rows] = 2 * i + (binned[rows, j] > b)
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.value[t] = self.rate * gs / (hs + self.l2)
            score += self.value[t][node]
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, edges: list) -> tuple[int, int] | None:
        k = b.shape[1]
        flat = (b + np.arange(k) * width).ravel()
        each = lambda w: np.bincount(flat, np.repeat(w, k), k * width).reshape(k, width).cumsum(1)
        gl, hl, nl = each(g), each(h), each(np.ones(len(g)))
        gt, ht, nt = g.sum(), h.sum(), len(g)
        gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
        gain[(nl < self.least) | (nt - nl < self.least)] = 0
        for j, e in enumerate(edges):
            gain[j, len(e) :] = 0
        at = int(gain.argmax())
        return divmod(at, width) if gain.flat[at] > 1e-9 else None

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.edge[t, node])
            out += self.value[t][node - (2**self.depth - 1)]
        return out


class Isotonic:
    """The nondecreasing fit of labels to scores by pooling adjacent violators, linear between block means, with one pseudo row of the mean in each block."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
        values, begin = np.unique(score[order], return_index=True)
        if not len(values):
            self.at, self.to = [0.0], [0.5]
            return self
        for part_y, v in zip(np.split(y[order].astype(float), begin[1:]), values, strict=True):
            blocks.append([len(part_y), part_y.sum(), v * len(part_y)])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                w, s, z = blocks.pop()
                blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + z]
        mean = float(y.mean())
        self.at = [z / w for w, _, z in blocks]
        self.to = [(s + mean) / (w + 1) for w, s, _ in blocks]
        self.to = np.maximum.accumulate(self.to).tolist()
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.to)
