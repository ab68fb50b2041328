"""Support vector machines by pairwise dual coordinate steps, in NumPy; one model is one task's work.

A step takes a point that violates its optimality condition and a partner, and moves both
multipliers along the line that keeps sum(alpha y) = 0, clipped to the box. Training ends when a
whole pass changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Options:
    C: float = 1.0
    tol: float = 1e-4
    max_iter: int = 1000
    eps: float = 1e-5
    jitter: float = 1e-6
    seed: int = 42
    #: Candidates scored for each violating point, of which the one with the largest change is taken.
    candidates: int = 0


@dataclass
class Model:
    status: str
    alpha: np.ndarray
    b: float = 0.0
    iterations: int = 0
    w: np.ndarray | None = None
    support: np.ndarray = field(default_factory=lambda: np.zeros(0, int))


def scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z-scores (std 0: 1) with unit length, NaN as 0."""
    mean, std = x.mean(0), x.std(0)
    return normalise(x, mean, std), mean, std


def normalise(x: np.ndarray, mean: np.ndarray, std: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    z = np.nan_to_num((x - mean) / np.where(std == 0, 1.0, std))
    return z / (np.linalg.norm(z, axis=-1, keepdims=True) + eps)


class Solver:
    """The state of one dual problem. row(i) gives the kernel of point i with all."""

    def __init__(self, row: Callable[[int], np.ndarray], diag: np.ndarray, y: np.ndarray, o: Options):
        self.row, self.diag, self.y, self.o = row, diag, y.astype(float), o
        self.alpha, self.b, self.f = np.zeros(len(y)), 0.0, np.zeros(len(y))
        self.rng = np.random.default_rng(o.seed)

    def errors(self) -> np.ndarray:
        return self.f + self.b - self.y

    def violates(self, i: int) -> bool:
        r = self.y[i] * (self.f[i] + self.b) - 1
        return (r < -self.o.tol and self.alpha[i] < self.o.C - self.o.eps) or (r > self.o.tol and self.alpha[i] > self.o.eps)

    def change(self, i: int, js: np.ndarray, ki: np.ndarray) -> np.ndarray:
        """The new multipliers of partners js."""
        y, a, c = self.y, self.alpha, self.o.C
        opposite = y[js] != y[i]
        low = np.where(opposite, np.maximum(0, a[js] - a[i]), np.maximum(0, a[js] + a[i] - c))
        high = np.where(opposite, np.minimum(c, c + a[js] - a[i]), np.minimum(c, a[js] + a[i]))
        curve = np.maximum(self.diag[i] + self.diag[js] - 2 * ki[js], self.o.jitter)
        e = self.errors()
        return np.where(high - low > 1e-12, np.clip(a[js] + y[js] * (e[i] - e[js]) / curve, low, high), a[js])

    def step(self, i: int, j: int, ki: np.ndarray) -> bool:
        if i == j:
            return False
        new = float(self.change(i, np.array([j]), ki)[0])
        moved = new - self.alpha[j]
        if abs(moved) < self.o.eps:
            return False
        other = -self.y[i] * self.y[j] * moved
        kj = self.row(j)
        ei, ej = self.errors()[[i, j]]
        b1 = self.b - ei - self.y[i] * other * self.diag[i] - self.y[j] * moved * ki[j]
        b2 = self.b - ej - self.y[i] * other * ki[j] - self.y[j] * moved * self.diag[j]
        self.alpha[i] = min(max(self.alpha[i] + other, 0.0), self.o.C)
        self.alpha[j] = new
        self.f += self.y[i] * other * ki + self.y[j] * moved * kj
        inside = lambda k: self.o.eps < self.alpha[k] < self.o.C - self.o.eps
        self.b = b1 if inside(i) else b2 if inside(j) else (b1 + b2) / 2
        return True

    def partners(self, i: int, ki: np.ndarray):
        """In the order in which they are tried."""
        n = len(self.y)
        if self.o.candidates:
            js = self.rng.integers(0, n, min(n, self.o.candidates))
            yield int(js[np.abs(self.change(i, js, ki) - self.alpha[js]).argmax()])
            return
        e = self.errors()
        yield int(np.abs(e - e[i]).argmax())
        free = np.flatnonzero((self.alpha > self.o.eps) & (self.alpha < self.o.C - self.o.eps))
        yield from map(int, self.rng.permutation(free))
        yield from map(int, self.rng.permutation(n))

    def opposite(self, i: int, ki: np.ndarray):
        """A random point of the other class; where that changes nothing, all others."""
        others = np.flatnonzero(self.y != self.y[i])
        if len(others):
            yield int(self.rng.choice(others))
        yield from self.partners(i, ki)

    def solve(self, partners, least_passes: int = 2) -> int:
        for it in range(self.o.max_iter):
            changed = 0
            for i in self.rng.permutation(len(self.y)):
                if self.violates(int(i)):
                    ki = self.row(int(i))
                    changed += any(self.step(int(i), j, ki) for j in partners(int(i), ki))
            if not changed and it + 1 >= least_passes:
                return it + 1
        return self.o.max_iter


def fit_linear(x: np.ndarray, y: np.ndarray, o: Options | None = None) -> Model:
    """y in -1, 1. A zero-variance matrix or a single class is returned unfitted."""
    o = o or Options()
    if not len(x) or not x.var() or len(set(y.tolist())) < 2:
        return Model("degenerate", np.zeros(len(y)), w=np.zeros(x.shape[1] if x.ndim > 1 else 0))
    s = Solver(lambda i: x @ x[i], (x * x).sum(1), y, o)
    n = s.solve(lambda i, ki: s.opposite(i, ki))
    return Model("fitted", s.alpha, s.b, n, (s.alpha * y) @ x, np.flatnonzero(s.alpha > o.eps))


def rbf_matrix(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0))


def fit_kernel(k: np.ndarray, y: np.ndarray, o: Options | None = None) -> Model:
    """From a Gram matrix."""
    o = o or Options()
    if len(set(y.tolist())) < 2:
        return Model("degenerate", np.zeros(len(y)))
    s = Solver(lambda i: k[i], np.diag(k).copy(), y, o)
    n = s.solve(lambda i, ki: s.partners(i, ki))
    return Model("fitted", s.alpha, s.b, n, support=np.flatnonzero(s.alpha > o.eps))


#: Points up to which a Gram matrix is held (n^2 memory); beyond, its rows are computed as they are needed.
GRAM = 5_000


def fit_rbf(x: np.ndarray, y: np.ndarray, gamma: float, o: Options | None = None) -> Model:
    """A kernel model of any number of points."""
    o = o or Options()
    if len(x) <= GRAM or len(set(y.tolist())) < 2:
        return fit_kernel(rbf_matrix(x, x, gamma) if len(x) <= GRAM else np.zeros((0, 0)), y, o)
    square = (x * x).sum(1)
    s = Solver(lambda i: np.exp(-gamma * np.maximum(square + square[i] - 2 * (x @ x[i]), 0)), np.ones(len(x)), y, o)
    n = s.solve(lambda i, ki: s.partners(i, ki))
    return Model("fitted", s.alpha, s.b, n, support=np.flatnonzero(s.alpha > o.eps))


def fit_pairs_linear(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, y: np.ndarray, o: Options | None = None) -> Model:
    """A linear model of concatenated vectors that are never stored: row = left[pairs[:, 0]] . . + right[pairs[:, 1]] . ."""
    o = o or Options()
    i, j = pairs[:, 0], pairs[:, 1]
    gl, gr = left @ left.T, right @ right.T
    s = Solver(lambda r: gl[i[r], i] + gr[j[r], j], gl[i, i] + gr[j, j], y, o)
    if len(set(y.tolist())) < 2:
        return Model("degenerate", s.alpha)
    n = s.solve(lambda a, ki: s.opposite(a, ki))
    c = s.alpha * y
    w = np.concatenate([np.bincount(i, c, len(left)) @ left, np.bincount(j, c, len(right)) @ right])
    return Model("fitted", s.alpha, s.b, n, w, np.flatnonzero(s.alpha > o.eps))


def fit_pairs_kernel(gl: np.ndarray, gr: np.ndarray, pairs: np.ndarray, y: np.ndarray, o: Options | None = None) -> Model:
    """The product of two Gram matrices at index pairs; partners are the best of random candidates (128 by default)."""
    o = o or Options(candidates=128)
    i, j = pairs[:, 0], pairs[:, 1]
    s = Solver(lambda r: gl[i[r], i] * gr[j[r], j], gl[i, i] * gr[j, j], y, o)
    if len(set(y.tolist())) < 2:
        return Model("degenerate", s.alpha)
    n = s.solve(lambda a, ki: s.partners(a, ki))
    return Model("fitted", s.alpha, s.b, n, support=np.flatnonzero(s.alpha > o.eps))


def decide_linear(m: Model, x: np.ndarray) -> np.ndarray:
    return x @ m.w + m.b


def decide_kernel(m: Model, k: np.ndarray, y: np.ndarray) -> np.ndarray:
    """k: rows to score by training points. Only support vectors count."""
    sv = m.support
    return k[:, sv] @ (m.alpha[sv] * y[sv]) + m.b


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """By mid-ranks; NaN with one class."""
    p = int((y > 0).sum())
    q = len(y) - p
    if not p or not q:
        return float("nan")
    _, inv, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inv]
    return float((rank[y > 0].sum() - p * (p + 1) / 2) / (p * q))
