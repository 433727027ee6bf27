"""Small models in numpy, for bounded samples that fit one task: boosted trees over binned features, and a linear model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np

#: Bins of a feature; one more holds missing values.
BINS = 64
#: Depth of a tree, rows in a leaf at least, rows that one tree is grown on.
DEPTH, LEAF, ROWS = 5, 20, 4000
RATE, ROUNDS, TREES = 0.1, 100, 500
#: Character runs that a text model knows.
VOCABULARY = 3000


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def binned(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers of bins with bounds from ``train``; missing values (NaN) are the last bin."""
    out = [np.full(a.shape, BINS, np.int64) for a in (train, test)]
    for k in range(train.shape[1]):
        known = np.unique(train[~np.isnan(train[:, k]), k])
        if len(known) > BINS:
            known = np.unique(np.quantile(train[~np.isnan(train[:, k]), k], np.arange(1, BINS) / BINS))
            bounds = known
        else:
            bounds = (known[1:] + known[:-1]) / 2
        for a, b in zip((train, test), out):
            some = ~np.isnan(a[:, k])
            b[some, k] = np.searchsorted(bounds, a[some, k], "left")
    return out[0], out[1]


def _tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
    """A tree of Newton steps, level by level: per level the feature, bin and side of missing values at which each node splits, and at the end the
    values of the leaves. A node that doesn't gain by a split sends all its rows to the left."""
    n, d = bins.shape
    width, node, levels = BINS + 1, np.zeros(n, np.int64), []
    flat = bins + np.arange(d) * width
    for depth in range(DEPTH):
        nodes = 1 << depth
        at = (node[:, None] * (d * width) + flat).ravel()
        size = nodes * d * width
        sums = [np.bincount(at, np.repeat(w, d), size).reshape(nodes, d, width) for w in (g, h)]
        count = np.bincount(at, minlength=size).reshape(nodes, d, width)
        (gl, hl), cl = (np.cumsum(s[:, :, :-1], 2)[:, :, :-1] for s in sums), np.cumsum(count[:, :, :-1], 2)[:, :, :-1]
        total = [s.sum(2)[:, :, None] for s in (*sums, count)]
        gains = []
        for missing in (0, 1):  # missing values to the left or to the right
            a, b, c = (x + missing * s[:, :, -1:] for x, s in zip((gl, hl, cl), (*sums, count)))
            gain = a * a / (b + 1e-3) + (total[0] - a) ** 2 / (total[1] - b + 1e-3) - total[0] ** 2 / (total[1] + 1e-3)
            gains.append(np.where((c >= LEAF) & (total[2] - c >= LEAF), gain, -1.0))
        both = np.stack(gains, 3).reshape(nodes, -1)
        best = both.argmax(1)
        feature, rest = np.divmod(best, (BINS - 1) * 2)
        split, left = np.divmod(rest, 2)
        split = np.where(both[np.arange(nodes), best] > 1e-9, split, BINS)
        levels.append((feature, split, left))
        node = _down(bins, node, feature, split, left)
    leaves = 1 << DEPTH
    return [*levels, -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1e-3)]


def _down(bins, node, feature, split, left):
    own = bins[np.arange(len(bins)), feature[node]]
    right = np.where(own == BINS, left[node] == 0, own > split[node]) & (split[node] < BINS)
    return 2 * node + right


def _value(bins: np.ndarray, tree: list) -> np.ndarray:
    node = np.zeros(len(bins), np.int64)
    for level in tree[:-1]:
        node = _down(bins, node, *level)
    return tree[-1][node]


def boosted(train: np.ndarray, y: np.ndarray, classes: int, test: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities of the classes for ``test`` by gradient boosting; missing values go to whichever side suits. Each tree is grown on at most
    ``ROWS`` rows drawn at random; with many classes there are fewer rounds, so that the trees number at most about ``TREES``."""
    rng = np.random.default_rng(seed)
    a, b = binned(train, test)
    share = np.bincount(y, minlength=classes) / len(y)
    outputs = 1 if classes == 2 else classes
    start = np.log(np.maximum(share, 1e-9))
    start = start[1:] - start[:1] if outputs == 1 else start
    za, zb = np.tile(start, (len(a), 1)), np.tile(start, (len(b), 1))
    for _ in range(max(20, min(ROUNDS, TREES // outputs))):
        p = 1 / (1 + np.exp(-za)) if outputs == 1 else softmax(za)
        for k in range(outputs):
            of = (y == (1 if outputs == 1 else k)).astype(float)
            rows = rng.choice(len(a), ROWS, False) if len(a) > ROWS else np.arange(len(a))
            q = p[rows, k]
            tree = _tree(a[rows], q - of[rows], np.maximum(q * (1 - q), 1e-6))
            za[:, k] += RATE * _value(a, tree)
            zb[:, k] += RATE * _value(b, tree)
    if outputs == 1:
        q = 1 / (1 + np.exp(-zb[:, 0]))
        return np.stack([1 - q, q], 1)
    return softmax(zb)


class Sparse:
    """A matrix of few non-zero entries: rows' starts, columns and values."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.shape, self.columns = (len(starts) - 1, width), columns
        self.values = values.astype(np.float32)[:, None]
        self.rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.argsort(columns, kind="stable")
        self.by_column = columns[order], self.rows[order], self.values[order]

    @staticmethod
    def _sums(of: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
        """Sums of rows by sorted group numbers."""
        out = np.zeros((n, of.shape[1]))
        if len(groups):
            new = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            out[groups[new]] = np.add.reduceat(of, new)
        return out

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w.astype(np.float32)[self.columns] * self.values, self.rows, self.shape[0])

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        columns, rows, values = self.by_column
        return self._sums(r.astype(np.float32)[rows] * values, columns, self.shape[1])


def minimized(f: Callable, x: np.ndarray, steps: int, memory: int = 10, tolerance: float = 1e-4) -> np.ndarray:
    """The minimum of a smooth convex function, which gives value and gradient, by a quasi-Newton method of limited memory."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() < tolerance:
            break
        q, weights = slope.copy(), []
        for s, t in reversed(past):
            w = s @ q / (s @ t)
            q -= w * t
            weights.append(w)
        if past:
            s, t = past[-1]
            q *= (s @ t) / (t @ t)
        for (s, t), w in zip(past, reversed(weights)):
            q += s * (w - t @ q / (s @ t))
        size, down = (1.0 if past else min(1.0, 1 / np.abs(slope).sum())), slope @ q
        while True:
            new = x - size * q
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * size * down or size < 1e-10:
                break
            size /= 2
        s, t = new - x, new_slope - slope
        if s @ t > 1e-12:
            past = [*past, (s, t)][-memory:]
        x, value, slope = new, new_value, new_slope
    return x


def linear(train, y: np.ndarray, classes: int, test, strength: float, steps: int = 100) -> np.ndarray:
    """Probabilities of the classes for ``test`` by multinomial regression. The squared weights count 1 / ``strength`` against the summed loss, the
    offsets don't count. Matrices are dense or :class:`Sparse`."""
    n, d = train.shape
    times = train.transposed_times if isinstance(train, Sparse) else lambda r: train.T @ r
    own = np.zeros((n, classes))
    own[np.arange(n), y] = 1

    def loss(flat):
        w = flat.reshape(d + 1, classes)
        p = softmax(train @ w[:-1] + w[-1])
        value = -np.log(np.maximum(p[np.arange(n), y], 1e-300)).mean() + (w[:-1] ** 2).sum() / (2 * strength * n)
        off = (p - own) / n
        return value, np.concatenate([times(off) + w[:-1] / (strength * n), off.sum(0)[None, :]]).ravel()

    w = minimized(loss, np.zeros((d + 1) * classes), steps).reshape(d + 1, classes)
    return softmax(test @ w[:-1] + w[-1])


def scaled(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by the means and deviations of ``train``; constant columns become 0."""
    mean, std = train.mean(0), train.std(0)
    std = np.where(std > 0, std, 1.0)
    return (train - mean) / std, (test - mean) / std


def runs_of(text: str, low: int = 2, high: int = 4) -> list[str]:
    """The runs of 2 to 4 characters of each word, which is padded by blanks; a word shorter than the run gives the whole padded word once."""
    padded = [f" {w} " for w in text.split()]
    return [p[i : i + n] for p in padded for n in range(low, high + 1) for i in range(len(p) - n + 1)]


def weighted_runs(train: list[list[str]], test: list[list[str]]) -> tuple[Sparse, Sparse]:
    """Character runs weighted by how often they occur in a text and in how few of the texts of ``train``, to length 1 per text. The
    ``VOCABULARY`` most frequent runs of ``train`` count, ties by name."""
    often = Counter(x for t in train for x in t)
    known = {x: k for k, (x, _) in enumerate(sorted(often.items(), key=lambda c: (-c[1], c[0]))[:VOCABULARY])}
    within = Counter(x for t in train for x in set(t))
    rarity = np.array([np.log((1 + len(train)) / (1 + within[x])) + 1 for x in known])
    out = []
    for texts in (train, test):
        starts, columns, values = [0], [], []
        for t in texts:
            own = Counter(known[x] for x in t if x in known)
            w = np.array(list(own.values()), float) * rarity[list(own)] if own else np.zeros(0)
            columns += own
            values.append(w / np.linalg.norm(w) if own else w)
            starts.append(len(columns))
        out.append(Sparse(np.array(starts), np.array(columns, np.int64), np.concatenate(values) if values else np.zeros(0), len(known)))
    return out[0], out[1]


def area(score: np.ndarray, own: np.ndarray) -> float:
    """The area under the curve by average ranks."""
    _, back, n = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[back]
    k = int(own.sum())
    return float((ranks[own].sum() - k * (k + 1) / 2) / (k * (len(own) - k)))
