"""Stable projections of vectors, and the search of a kd-tree in the projection that a chi-square test stops.

A vector's image has two parts: its first principal components, which hold their share of any squared distance exactly, and
a Gaussian (2-stable) projection of what is left, whose squared length over the true one follows a chi-square law. With the
confidence's quantile q, a vector at squared distance D lies within q D of the query in ``image``, so a candidate whose image is
farther away than q times the k-th squared distance so far need not be verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marchland.operators.tree_knn import Leaves, Space, vectors

#: With no more components than this nothing is projected.
PROJECTED = 6
PRINCIPAL = 16
GAUSSIAN = 2


def projection(d: int, m: int = PROJECTED, seed: int = 7) -> np.ndarray:
    """d × m standard normal numbers (a 2-stable projection); with no more than m dimensions nothing is projected."""
    return np.eye(d) if d <= m else np.random.default_rng(seed).standard_normal((d, m))


def chi2_quantile(p: float, m: int) -> float:
    """Inverse of the chi-square distribution function by bisection on the regularised incomplete gamma series."""

    def cdf(x: float) -> float:
        a, t = m / 2, x / 2
        term = total = 1 / a
        n = 0
        while term > total * 1e-15 and n < 10_000:
            n += 1
            term *= t / (a + n)
            total += term
        return total * math.exp(-t + a * math.log(t) - math.lgamma(a)) if t > 0 else 0.0

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def principal(rows: DataFrame, d: int, m: int, vec: str = "_v") -> np.ndarray:
    """d × m: the first principal axes of all rows, from one pass that sends d * (d + 1) + 1 sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + d + d * d)
        for b in batches:
            x = vectors(b.column(0), d)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "s"])

    got = {r["at"]: r["s"] for r in rows.select(vec).mapInArrow(sums, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    total = np.array([got.get(i, 0.0) for i in range(1 + d + d * d)])
    n = max(1.0, total[0])
    mean = total[1 : d + 1] / n
    _, axes = np.linalg.eigh(total[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :m]


class Principal(Space):
    """The first principal components alone: orthonormal axes never lengthen a distance, so all bounds are exact."""

    def __init__(self, axes: np.ndarray) -> None:
        super().__init__(len(axes))
        self.axes = axes

    def place(self, x: np.ndarray) -> np.ndarray:
        return x @ self.axes


class Projected(Space):
    """The image of d components: √q times the principal ones, then the Gaussian projection of the rest."""

    def __init__(self, axes: np.ndarray, confidence: float, m: int = GAUSSIAN, seed: int = 7) -> None:
        super().__init__(len(axes))
        self.factor = chi2_quantile(confidence, m)
        rest = np.eye(self.d) - axes @ axes.T
        self.image = np.concatenate([math.sqrt(self.factor) * axes, rest @ projection(self.d, m, seed)], axis=1)

    def place(self, x: np.ndarray) -> np.ndarray:
        return x @ self.image

    def leaves(self, x: np.ndarray, uid: np.ndarray, digits: int | None = None) -> Leaves:
        return ProjectedLeaves(self, x, uid, digits)


class ProjectedLeaves(Leaves):
    """Leaves whose candidates are verified one by one, nearest images first; ``verified`` and ``possible`` count pairs."""

    def __init__(self, space: Projected, x: np.ndarray, uid: np.ndarray, digits: int | None = None, size: int = 256) -> None:
        self.space, self.factor = space, space.factor
        super().__init__(x, uid, space.place(x), size, digits)
        self.y_sq = (self.y**2).sum(axis=1)
        self.verified = self.possible = 0

    def place(self, q: np.ndarray) -> np.ndarray:
        return self.space.place(q)

    def _verify(self, q: np.ndarray, y: np.ndarray, cand: np.ndarray, k: int, skip: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gap = (y**2).sum(axis=1)[:, None] + self.y_sq[cand] - 2 * (y @ self.y[cand].T)
        gap[skip[:, None] == self.uid[cand]] = np.inf
        n = len(cand)
        self.possible += len(q) * n
        if n > k and not np.isfinite(worst).all():
            # the k nearest images give a first bound
            first = np.argpartition(gap, k - 1, axis=1)[:, :k]
            rows = np.repeat(np.arange(len(q)), k)
            seen = np.isfinite(gap[rows, first.ravel()])
            d2 = np.full(len(rows), np.inf)
            d2[seen] = self._distances(q, rows[seen], cand[first.ravel()[seen]])
            worst = np.minimum(worst, d2.reshape(-1, k).max(axis=1))
        rows, col = np.nonzero((gap <= (self.factor * worst * (1 + 1e-9) + 1e-6)[:, None]) & np.isfinite(gap))
        self.verified += len(rows)
        d2 = self._distances(q, rows, cand[col])
        near = d2 <= worst[rows]
        return rows[near], d2[near], cand[col[near]]

    def _distances(self, q: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for s in range(0, len(rows), 1 << 15):
            diff = q[rows[s : s + (1 << 15)]] - self.x[at[s : s + (1 << 15)]]
            out[s : s + (1 << 15)] = np.einsum("ij,ij->i", diff, diff)
        return out if self.digits is None else np.round(out, self.digits)


def space_for(rows: DataFrame, d: int, confidence: float, vec: str = "_v") -> Space:
    """The vectors' own space up to PROJECTED components, where the search is exact; else a projection fitted to all rows."""
    if d <= PROJECTED:
        return Space(d)
    return Projected(principal(rows, d, min(PRINCIPAL, d // 2), vec), confidence)
