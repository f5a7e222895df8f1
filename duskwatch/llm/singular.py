"""Singular values and right vectors of a small square matrix: Householder bidiagonals, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Stands for a zero pivot; the matrix is scaled to entries of at most 1.
TINY = 1e-40


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, alpha): the reflection 1 - tau v v' maps x to alpha times the first unit vector."""
    norm = float(np.linalg.norm(x))
    if norm == 0:
        return np.zeros_like(x), 0.0, 0.0
    alpha = -norm if x[0] > 0 else norm
    v = x.copy()
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal a, superdiagonal b, P) with r = Q B P' for an orthogonal Q, which is not kept."""
    m = r.astype(float).copy()
    d = len(m)
    a, b, p = np.zeros(d), np.zeros(max(d - 1, 0)), np.eye(d)
    for k in range(d):
        v, tau, a[k] = _reflector(m[k:, k])
        m[k:, k:] -= np.outer(tau * v, v @ m[k:, k:])
        if k < d - 1:
            v, tau, b[k] = _reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ v, tau * v)
            p[:, k + 1 :] -= np.outer(p[:, k + 1 :] @ v, tau * v)
    return a, b, p


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One qd transformation with a shift; None if the shift is above the smallest eigenvalue. Also gives the least d."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        top = d + e[i]
        new_q[i] = top
        if top > 0:
            t = q[i + 1] / top
            new_e[i] = e[i] * t
            d = d * t - shift
        else:
            d = q[i + 1] - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, least


def qd_eigenvalues(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the upper bidiagonal (a, b), falling, each to high relative accuracy."""
    tolerance = (10 * EPS) ** 2
    found: list[float] = []
    todo = [([float(x) for x in a * a], [float(x) for x in b * b], 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        if q and q[0] < q[-1]:
            # reversed, the bidiagonal is lower, and its transpose upper again: same singular values, small ones last
            q, e = q[::-1], e[::-1]
        least = 0.0
        while q:
            n = len(q)
            if n == 1 or e[-1] <= tolerance * (sigma + q[-1]):
                found.append(sigma + q.pop())
                if e:
                    e.pop()
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tolerance * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # an eigenvalue lies within the coupling of the last diagonal entry
            shift = max(q[-1] + e[-1] - (q[-2] * e[-1]) ** 0.5, 0.25 * least, 0.0)
            step = None
            for _ in range(4):
                step = _dqds(q, e, shift) if shift else None
                if step:
                    break
                shift *= 0.25
            if not step:
                shift, step = 0.0, _dqds(q, e, 0.0)
            q, e, least = step
            sigma += shift
    return np.sort(np.array(found))[::-1]


class Twisted:
    """Twisted factorisation of B'B - lam: a stationary sweep from the top meets a progressive one where they fit best."""

    def __init__(self, a: np.ndarray, b: np.ndarray, lam: float):
        n = len(a)
        q = a * a
        low = b / a[:-1]
        self.down, self.top = np.zeros(max(n - 1, 0)), np.zeros(n)
        self.up, self.bottom = np.zeros(max(n - 1, 0)), np.zeros(n)
        s, p = np.zeros(n), np.zeros(n)
        guard = lambda x: x if abs(x) > TINY else TINY
        s[0], p[-1] = -lam, q[-1] - lam
        for i in range(n - 1):
            self.top[i] = guard(s[i] + q[i])
            self.down[i] = q[i] * low[i] / self.top[i]
            s[i + 1] = self.down[i] * low[i] * s[i] - lam
        for i in range(n - 2, -1, -1):
            self.bottom[i + 1] = guard(q[i] * low[i] ** 2 + p[i + 1])
            t = q[i] / self.bottom[i + 1]
            self.up[i] = low[i] * t
            p[i] = p[i + 1] * t - lam
        gamma = s + p + lam
        self.at = int(np.argmin(np.abs(gamma)))
        self.gamma = guard(gamma[self.at])

    def _spread(self, z: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            z[i] -= self.down[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] -= self.up[i] * z[i]
        return z

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.top))
        z[self.at] = 1.0
        z = self._spread(z)
        return z / np.linalg.norm(z)


def leading_vectors(r: np.ndarray, most: int, near: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling; unit right vectors as columns): the first ``most`` that are above rounding error.

    Vectors whose values are ``near`` each other are made orthogonal. Where a twisted vector is not new,
    as with equal values, the vectors found are split off and the rest is solved in their complement.
    """
    d = len(r)
    scale = float(np.abs(r).max()) if d else 0.0
    if scale == 0 or not np.isfinite(scale):
        return np.zeros(0), np.zeros((d, 0))
    a, b, p = bidiagonalise(r / scale)
    values = qd_eigenvalues(a, b)
    keep = values[:most]
    keep = keep[keep > values[0] * (d * EPS) ** 2 * 16]
    floor = EPS * EPS * float(np.sqrt(values[0]))
    a = np.where(np.abs(a) < floor, floor, a)
    z = np.zeros((d, len(keep)))
    for k, lam in enumerate(keep):
        close = z[:, [j for j in range(k) if keep[j] - lam <= near * keep[j]]]
        x = Twisted(a, b, float(lam)).vector()
        x -= close @ (close.T @ x)
        size = float(np.linalg.norm(x))
        if size < 0.5:
            known = p @ z[:, :k]
            others = np.linalg.qr(known, mode="complete")[0][:, k:]
            more, v = leading_vectors(np.linalg.qr(r @ others, mode="r"), len(keep) - k, near)
            return np.concatenate([keep[:k] * scale * scale, more]), np.hstack([known, others @ v])
        x /= size
        x -= close @ (close.T @ x)
        z[:, k] = x / np.linalg.norm(x)
    return keep * scale * scale, p @ z
