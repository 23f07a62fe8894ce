"""Boosted regression trees on binned features, logistic loss, and isotonic calibration.

The trees are grown from sums over the rows: per node, feature and bin the
gradients, their weights and the row counts. ``Counted`` works them out for
rows in memory; what gives the same sums from rows on the executors grows the
same trees, since all of them are whole numbers (gradients in units of
``1 / UNIT``) and so add up to the same in any order. The model is a few
kilobytes and travels inside the task's closure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

BINS = 32
UNIT = 2.0 ** 24


def _bins(x: np.ndarray, most: int = BINS) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, most + 1)[1:-1], method="lower")) for c in x.T]


def coded(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The bin of every value: ``x > cut`` where ``code > index of the cut``."""
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1).astype(np.uint8)


class Counted:
    """Distinct coded rows with their count and the count of those labelled."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, y: np.ndarray):
        self.codes, self.n, self.y = codes, n, y
        self.score: np.ndarray | None = None
        self.seen = 0

    def sums(self, trees: BoostedTrees, tree: list, level: int) -> np.ndarray:
        """(gradient, weight, count) x node of the level x feature x bin."""
        if self.score is None:
            self.score = np.full(len(self.n), trees.start)
        for done in trees.coded[self.seen:]:
            self.score += trees._tree(done, self.codes)
        self.seen = len(trees.coded)
        first, width = 2 ** level - 1, 2 ** level
        node = trees._node(tree, self.codes) - first
        rows = np.flatnonzero(node >= 0)
        p = 1 / (1 + np.exp(-self.score[rows]))
        n = self.n[rows]
        of_row = (np.rint((self.y[rows] - n * p) * UNIT), np.rint(n * p * (1 - p) * UNIT), n)
        out = np.zeros((3, width, self.codes.shape[1], BINS))
        for f in range(self.codes.shape[1]):
            at = node[rows] * BINS + self.codes[rows, f]
            for i, w in enumerate(of_row):
                out[i, :, f] = np.bincount(at, w, width * BINS).reshape(width, BINS)
        return out


class BoostedTrees:
    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, least: int = 20, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        # the same trees, split at values and at bins
        self.trees: list[list[tuple[int, float, float]]] = []
        self.coded: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = _bins(x)
        return self.fit_sums(cuts, len(y), y.sum(), Counted(coded(cuts, x), np.ones(len(y)), y).sums)

    def fit_sums(self, cuts: list[np.ndarray], n: float, labelled: float,
                 sums: Callable[[BoostedTrees, list, int], np.ndarray]) -> BoostedTrees:
        """Grow from ``sums(self, tree so far, level)`` over ``n`` rows (see ``Counted.sums``)."""
        mean = min(max(labelled / n, 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        for _ in range(self.rounds):
            tree = self._grow(cuts, sums)
            self.coded.append(tree)
            self.trees.append([(f, float(cuts[f][int(k)]) if f >= 0 else 0.0, v) for f, k, v in tree])
        return self

    def _grow(self, cuts, sums):
        """A complete tree in heap order: (feature, cut's index, value); feature -1 is a leaf."""
        tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        value = lambda g, h: float(self.rate * g / (h + self.ridge))
        grown = {0}
        for level in range(self.depth):
            first = 2 ** level - 1
            nodes = [node for node in range(first, 2 * first + 1) if node in grown]
            if not nodes:
                break
            table = sums(self, tree, level)
            for node in nodes:
                gradient, weight, rows = table[:, node - first]
                gradient, weight = gradient / UNIT, weight / UNIT
                total_g, total_h, total = gradient[0].sum(), weight[0].sum(), rows[0].sum()
                if node == 0:
                    tree[0] = (-1, 0.0, value(total_g, total_h))
                best = (1e-6, -1, 0)
                if total < 2 * self.least:
                    continue
                for f, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    sum_g, sum_h, count = (np.cumsum(w[f])[:len(cut)] for w in (gradient, weight, rows))
                    gain = (sum_g ** 2 / (sum_h + self.ridge) + (total_g - sum_g) ** 2 / (total_h - sum_h + self.ridge)
                            - total_g ** 2 / (total_h + self.ridge))
                    gain[(count < self.least) | (total - count < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k, sum_g[k], sum_h[k])
                if best[1] >= 0:
                    _, f, k, left_g, left_h = best
                    tree[node] = (f, float(k), tree[node][2])
                    tree[2 * node + 1] = (-1, 0.0, value(left_g, left_h))
                    tree[2 * node + 2] = (-1, 0.0, value(total_g - left_g, total_h - left_h))
                    grown |= {2 * node + 1, 2 * node + 2}
        return tree

    @staticmethod
    def _node(tree, x: np.ndarray) -> np.ndarray:
        """The leaf every row ends in."""
        feature, cut, _ = (np.array(c) for c in zip(*tree))
        node = np.zeros(len(x), np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)

    @classmethod
    def _tree(cls, tree, x: np.ndarray) -> np.ndarray:
        return np.array([v for *_, v in tree])[cls._node(tree, x)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))

    def raw_of_codes(self, codes: np.ndarray) -> np.ndarray:
        return self.start + sum((self._tree(t, codes) for t in self.coded), np.zeros(len(codes)))


def pooled(rows: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Blocks (labelled, count, lowest and highest score) of rising shares, from such
    blocks in order of score. Pooling in parts first gives the same blocks."""
    blocks: list[list[float]] = []
    for v, n, low, top in rows:
        if blocks and blocks[-1][3] == low:
            blocks[-1][0] += v
            blocks[-1][1] += n
            blocks[-1][3] = top
        else:
            blocks.append([v, n, low, top])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, top2 = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = top2
    return blocks


class Isotonic:
    """Calibration: the best non-decreasing map from raw scores to probabilities."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        return self.of_blocks(pooled((v, 1, s, s) for s, v in zip(raw[order].tolist(), y[order].tolist())))

    def of_blocks(self, blocks: list[list[float]]) -> Isotonic:
        self.low = np.array([b[2] for b in blocks])
        self.p = np.array([b[0] / b[1] for b in blocks])
        self.n = np.array([b[1] for b in blocks])
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.low):
            return np.zeros(len(raw))
        return self.p[np.maximum(np.searchsorted(self.low, raw, side="right") - 1, 0)]
