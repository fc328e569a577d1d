"""Singular values and right singular vectors of a small triangular matrix: Householder bidiagonals, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLUSTER = 1e-4  # relative distance of eigenvalues below which their vectors are made orthogonal to each other


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U' a W, and W, by Householder reflections from both sides. ``a`` is square."""
    a = a.astype(float, copy=True)
    n = len(a)
    w = np.eye(n)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        length = np.linalg.norm(x)
        if length == 0 or not x[1:].any():
            return None
        v = x / length
        v[0] += 1.0 if v[0] >= 0 else -1.0
        return v / np.linalg.norm(v)

    for k in range(n):
        v = mirror(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < n:
            v = mirror(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _pass(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One differential quotient-difference transform with a shift. Its d must stay positive, else the shift was too large."""
    n = len(q)
    new_q, new_e, ds = np.empty(n), np.empty(n - 1), np.empty(n)
    d = q[0] - shift
    for k in range(n - 1):
        ds[k] = d
        new_q[k] = d + e[k]
        t = q[k + 1] / new_q[k]
        new_e[k] = e[k] * t
        d = d * t - shift
    ds[n - 1] = new_q[n - 1] = d
    return new_q, new_e, ds


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal with squared diagonal q > 0 and squared superdiagonal e.

    The shift is 1 / sum(1 / d) of a pass without shift: the d are reciprocals of the diagonal of the inverse, whose trace is
    the sum of reciprocals of the eigenvalues, so the shift never exceeds the least one.
    """
    out: list[float] = []
    blocks = [(q.astype(float), e.astype(float), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while True:
            n = len(q)
            if n == 1:
                out.append(float(q[0] + moved))
                break
            small = np.flatnonzero(e <= (0.1 * EPS) ** 2 * (moved + np.minimum(q[:-1], q[1:])))
            if len(small):
                at = int(small[-1])
                blocks.append((q[: at + 1], e[:at], moved))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if q[0] < q[-1]:  # the small end belongs last
                q, e = q[::-1].copy(), e[::-1].copy()
            q, e, d = _pass(q, e, 0.0)
            shift = 0.0
            if (d > 0).all():
                shift = float(1.0 / np.sum(1.0 / d)) * (1 - 4 * n * EPS)
            while shift > EPS * (moved + shift):
                new_q, new_e, d = _pass(q, e, shift)
                if (d > 0).all():
                    q, e, moved = new_q, new_e, moved + shift
                    break
                shift *= 0.5
            else:
                if shift:  # what is left of the last value cannot be told from the shifts made so far
                    out.append(float(moved + q[-1]))
                    q, e = q[:-1], e[:-1]
                    continue
    return np.sort(np.array(out))[::-1]


class Twisted:
    """Twisted factorisation of T - x for T = B' B: from both ends to the row where the least is left."""

    def __init__(self, b: np.ndarray, c: np.ndarray, x: float):
        n = len(b)
        d, low = b * b, np.where(b[:-1] != 0, c / np.where(b[:-1] != 0, b[:-1], 1.0), 0.0)
        tiny = EPS * EPS * max(x, float(d.max()))
        keep = lambda v: v if abs(v) > tiny else -tiny
        self.down, self.up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        self.plus, self.minus = np.empty(n), np.empty(n)
        s, stationary = -x, np.empty(n)
        for k in range(n - 1):
            stationary[k] = s
            self.plus[k] = keep(d[k] + s)
            self.down[k] = d[k] * low[k] / self.plus[k]
            s = self.down[k] * low[k] * s - x
        stationary[n - 1], self.plus[n - 1] = s, keep(d[n - 1] + s)
        p, progressive = d[n - 1] - x, np.empty(n)
        for k in range(n - 2, -1, -1):
            progressive[k + 1] = p
            self.minus[k + 1] = keep(d[k] * low[k] * low[k] + p)
            t = d[k] / self.minus[k + 1]
            self.up[k] = low[k] * t
            p = p * t - x if low[k] else d[k] - x
        progressive[0], self.minus[0] = p, keep(p)
        gamma = stationary + progressive + x
        self.row = int(np.argmin(np.abs(gamma)))
        self.gamma = keep(float(gamma[self.row]))

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.plus))
        z[self.row] = 1.0
        return self._back(z)

    def _back(self, z: np.ndarray) -> np.ndarray:
        for k in range(self.row - 1, -1, -1):
            z[k] -= self.down[k] * z[k + 1]
        for k in range(self.row, len(z) - 1):
            z[k + 1] -= self.up[k] * z[k]
        return z / np.linalg.norm(z)

    def solve(self, y: np.ndarray) -> np.ndarray:
        """The direction of the solution of (T - x) z = y: one step of inverse iteration."""
        y = y.astype(float, copy=True)
        for k in range(self.row):
            y[k + 1] -= self.down[k] * y[k]
        for k in range(len(y) - 1, self.row, -1):
            y[k - 1] -= self.up[k - 1] * y[k]
        z = np.empty(len(y))
        z[: self.row], z[self.row + 1 :] = y[: self.row] / self.plus[: self.row], y[self.row + 1 :] / self.minus[self.row + 1 :]
        z[self.row] = y[self.row] / self.gamma
        return self._back(z / np.abs(z).max())


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Up to ``most`` largest eigenvalues of r' r above rounding, their unit vectors as columns, and the sum of all eigenvalues."""
    n = len(r)
    scale = float(np.abs(r).max()) if r.size else 0.0
    if scale == 0.0:
        return np.empty(0), np.empty((n, 0)), 0.0
    b, c, w = bidiagonal(r / scale)
    floor = EPS * EPS  # far below what counts; keeps the quotients of the transforms finite
    b, c = np.where(np.abs(b) < floor, floor, b), np.where(np.abs(c) < floor, 0.0, c)
    values = dqds(b * b, c * c)
    values = values[values > (n * EPS) ** 2 * values[0]]
    total, values = float(values.sum()), values[:most]
    rng = np.random.default_rng(0)
    found = np.empty((n, len(values)))
    start = 0
    for k, x in enumerate(values):
        if k and values[k - 1] - x > CLUSTER * values[k - 1]:
            start = k
        factors = Twisted(b, c, x)
        z = factors.vector()
        near = found[:, start:k]
        if near.shape[1]:
            factors = Twisted(b, c, x * (1 + 32 * EPS))  # beside the value, so that no one vector of the cluster drowns the others
            for _ in range(4):
                rest = z - near @ (near.T @ z)
                if np.linalg.norm(rest) < 0.1:
                    rest = rng.standard_normal(n)
                    rest -= near @ (near.T @ rest)
                z = factors.solve(rest / np.linalg.norm(rest))
            for _ in range(2):
                z = z - near @ (near.T @ z)
                z /= np.linalg.norm(z)
        found[:, k] = z
    return values * scale * scale, w @ found, total * scale * scale
