"""Eigenvalues and eigenvectors of a scatter matrix under rank-one updates.

A ``Spectrum`` holds the number of rows, their mean and the decomposition of
their centred scatter matrix.  Adding ``z z'`` to the matrix moves every
eigenvalue into the gap above it, to the root of a secular equation

    1 + sum_j u_j^2 / (d_j - x) = 0,    u = vectors' z,

and the eigenvectors follow from the roots.  Directions that ``z`` does not
touch, and all but one of each set of equal eigenvalues after a rotation, are
deflated: they stay as they are.  The roots are sought relative to the nearer
pole and the update's components are recomputed from them, so the vectors stay
orthogonal to working precision however close the eigenvalues are.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum_j weights_j / (poles_j - x)`` for ascending poles
    and positive weights, one in each gap and one above the last pole; and the
    matrix of ``poles_j - root_i`` by root and pole.

    Each step puts one pole for the terms below and one for those above a root
    through their values and slopes and solves for the zero; a step that leaves
    the bracket is replaced by bisection.
    """
    k = len(poles)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    at = np.arange(k)
    below = (at[None, :] <= at[:, None]).astype(float)
    above = 1.0 - below
    middle = (poles + upper) / 2
    value = 1 + (weights / (poles - middle[:, None])).sum(1)
    near_upper = (value < 0) & (at < k - 1)
    origin = np.where(near_upper, upper, poles)
    distance = poles[None, :] - origin[:, None]
    gap = upper - poles
    low = np.where(near_upper, -gap / 2, 0.0)
    high = np.where(near_upper, 0.0, np.where(value < 0, gap, gap / 2))
    low = np.where((at == k - 1) & (value < 0), gap / 2, low)
    x = (low + high) / 2
    right = np.minimum(at + 1, k - 1)
    for _ in range(80):
        diff = distance - x[:, None]
        term = weights / diff
        slope = term / diff
        psi, phi = np.einsum("ij,ij->i", term, below), np.einsum("ij,ij->i", term, above)
        f = 1 + psi + phi
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        done = (np.abs(f) <= 4 * EPS * k * (1 - psi + phi)) | (high - low <= EPS * np.abs(x))
        if done.all():
            break
        dpsi, dphi = np.einsum("ij,ij->i", slope, below), np.einsum("ij,ij->i", slope, above)
        left_gap, right_gap = diff[at, at], diff[at, right]
        q, s = left_gap**2 * dpsi, right_gap**2 * dphi
        a = 1 + psi - left_gap * dpsi + phi - right_gap * dphi
        b = a * (left_gap + right_gap) + q + s
        c = left_gap * right_gap * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(b * b - 4 * a * c, 0))
            step = np.where(b <= 0, (b - root) / (2 * a), 2 * c / (b + root))
            step[-1] = left_gap[-1] + q[-1] / (a[-1] - phi[-1])
        new = x + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return origin + x, distance - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decomposition of ``vectors diag(values) vectors' + z z'``; values
    ascend, vectors are columns."""
    u = vectors.T @ z
    size = float(u @ u)
    if not size:
        return values, vectors
    tolerance = 8 * EPS * max(float(np.abs(values).max()), size)
    values, vectors = values.copy(), vectors.copy()
    u[np.abs(u) * np.sqrt(size) <= tolerance] = 0
    active = np.flatnonzero(u)
    # equal eigenvalues: turn each pair so that the update touches only one
    close = np.flatnonzero(np.diff(values[active]) <= 4 * tolerance)
    for j in close.tolist():
        a, b = active[j], active[j + 1]
        length = np.hypot(u[a], u[b])
        cos, sin = u[b] / length, u[a] / length
        if abs((values[b] - values[a]) * cos * sin) <= tolerance:
            va, vb = vectors[:, a].copy(), vectors[:, b]
            vectors[:, a], vectors[:, b] = cos * va - sin * vb, sin * va + cos * vb
            da, db = values[a], values[b]
            values[a], values[b] = da * cos**2 + db * sin**2, da * sin**2 + db * cos**2
            u[a], u[b] = 0, length
    active = np.flatnonzero(u)
    if not len(active):
        return values, vectors
    active = active[np.argsort(values[active], kind="stable")]
    poles = values[active]
    k = len(active)
    if k > 1 and (np.diff(poles) <= 0).any():  # a rotation left equal poles: part them by one unit
        poles = np.maximum.accumulate(poles) + np.arange(k) * EPS * max(poles[-1], size)
    roots, diff = secular_roots(poles, u[active] ** 2)
    # components that have exactly these roots
    below = np.arange(k)[None, :] < np.arange(k)[:, None]
    partner = np.where(below, poles[None, :], np.append(poles[1:], 0)[None, :]) - poles[:, None]
    partner[:, -1] = 1.0
    component = np.sqrt(np.prod(np.abs(diff.T / partner), axis=1)) * np.sign(u[active])
    turn = component[:, None] / diff.T
    turn /= np.sqrt(np.einsum("ij,ij->j", turn, turn))
    vectors[:, active] = vectors[:, active] @ turn
    values[active] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number of rows, their mean, and the decomposition of their scatter."""

    def __init__(self, dimensions: int):
        self.n = 0
        self.mean = np.zeros(dimensions)
        self.values, self.vectors = np.zeros(dimensions), np.eye(dimensions)

    @classmethod
    def of(cls, n: int, mean, values, vectors) -> Spectrum:
        own = cls(len(mean))
        own.n, own.mean, own.values = int(n), np.array(mean, float), np.array(values, float)
        own.vectors = np.array(vectors, float).reshape(len(own.mean), -1)
        return own

    def _add(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """``n`` rows of this mean whose centred scatter is that of ``rows``."""
        shift = mean - self.mean
        total = self.n + n
        for z in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, z)
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, shift * np.sqrt(self.n / total * n))
        self.mean = self.mean + shift * (n / total)
        self.n = total

    def add_rows(self, rows: np.ndarray, together: int) -> None:
        """Rows enter ``together`` at a time: centred on their own mean and, if
        they are more than their dimensions, turned into as many rows of the same
        scatter (a thin QR), each of which is one update.  One at a time, every
        row is an update of its own."""
        for at in range(0, len(rows), together):
            block = rows[at:at + together]
            mean = block.mean(0)
            centred = block - mean
            self._add(len(block), mean, np.linalg.qr(centred, mode="r") if len(block) > 1 else centred[:0])

    def add(self, other: Spectrum) -> None:
        """Another spectrum enters as one update per eigenpair, and one for the
        distance of the means."""
        self._add(other.n, other.mean, np.sqrt(np.maximum(other.values, 0))[:, None] * other.vectors.T)
