"""Singular values and right singular vectors of a small square matrix: Householder bidiagonals, dqds and twisted factorisations.

``dqds`` finds the squares of the singular values of a bidiagonal matrix from sums and quotients of positive numbers alone, so that each is
accurate relative to itself. A vector follows from the two factorisations of ``L D L^T - e`` that run from the top and from the bottom: where they
meet with the least remainder, the equations are solved outwards. Vectors of values that nearly agree are made orthogonal, by inverse
iteration where they coincide.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)
#: Steps of dqds for each value, at most; values whose relative distance is less are a cluster.
STEPS, CLUSTER = 100, 1e-5


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` and the first entry of ``x - 2 v (v x)``, whose other entries are zero."""
    v, size = x.copy(), float(np.linalg.norm(x))
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    first = -size if x[0] >= 0 else size
    v[0] -= first
    return v / np.linalg.norm(v), first


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and ``V`` with ``r = U B V^T``."""
    a, d = np.array(r, float), len(r)
    main, upper, v = np.zeros(d), np.zeros(max(d - 1, 0)), np.eye(d)
    for k in range(d):
        left, main[k] = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(left, left @ a[k:, k:])
        if k + 1 < d:
            right, upper[k] = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ right, right)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ right, right)
    return main, upper, v


def step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None where the shift is over the least value."""
    d, made_q, made_e = q[0] - shift, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        now = max(d + e[k], TINY)
        part = q[k + 1] / now
        made_q.append(now)
        made_e.append(e[k] * part)
        d = d * part - shift
    return None if d < 0 else ([*made_q, d], made_e)


def dqds(main: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values, falling."""
    q, e, found = [float(x) ** 2 for x in main], [float(x) ** 2 for x in upper], []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(STEPS * len(q)):
            n = len(q)
            if n == 1:
                break
            small = [k for k in range(n - 1) if e[k] <= EPS * EPS * (q[k] + q[k + 1]) or moved and e[k] <= EPS * EPS * moved]
            if small:  # the matrix falls into two
                k = small[-1]
                blocks.append((q[: k + 1], e[:k], moved))
                q, e = q[k + 1 :], e[k + 1 :]
                continue
            # least value of the last two rows: near the answer, often over it
            total, product = q[-2] + q[-1] + e[-1], q[-2] * q[-1]
            shift = 2 * product / (total + max(total * total - 4 * product, 0.0) ** 0.5) if total else 0.0
            shift *= 1 - 4 * EPS
            for tried in (shift, shift * (1 - 1e-6), shift * 0.75, shift * 0.25, 0.0):
                made = step(q, e, tried)
                if made:
                    (q, e), moved = made, moved + tried
                    break
            if q[0] * 1.5 < q[-1] and not moved:  # the least values are to be at the end; the transposed matrix, turned round, has the same ones
                q, e = q[::-1], e[::-1]
        else:
            raise RuntimeError("singular values did not settle")
        found.append(q[0] + moved)
    return np.array(sorted(found, reverse=True))


def twisted(main: np.ndarray, upper: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vector of ``B^T B`` for ``value``, and the factors from the top (pivots and multipliers)."""
    n = len(main)
    d, low = main**2, upper / main[:-1]
    s, p, pivots, down, up = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n - 1), np.zeros(n - 1)
    least = TINY / EPS + EPS * EPS * value
    s[0] = -value
    for i in range(n - 1):
        pivots[i] = s[i] + d[i]
        if abs(pivots[i]) < least:
            pivots[i] = -least
        down[i] = low[i] * d[i] / pivots[i]
        s[i + 1] = down[i] * low[i] * s[i] - value
    pivots[-1] = s[-1] + d[-1]
    if abs(pivots[-1]) < least:
        pivots[-1] = -least
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        below = d[i] * low[i] ** 2 + p[i + 1]
        if abs(below) < least:
            below = -least
        up[i] = low[i] * d[i] / below
        p[i] = p[i + 1] * d[i] / below - value
    at = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[at] = 1
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z), pivots, down


def solved(pivots: np.ndarray, down: np.ndarray, x: np.ndarray) -> np.ndarray:
    y = x.copy()
    for i in range(len(down)):
        y[i + 1] -= down[i] * y[i]
    y /= pivots
    for i in range(len(down) - 1, -1, -1):
        y[i] -= down[i] * y[i + 1]
    return y / np.linalg.norm(y)


def block_vectors(main: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (falling) and vectors (columns) of an unreduced block."""
    if len(main) == 1:
        return main**2, np.ones((1, 1))
    values, made, rng = dqds(main, upper), [], np.random.default_rng(1)
    for k, value in enumerate(values):
        z, pivots, down = twisted(main, upper, float(value))
        near = [made[j] for j in range(k) if values[j] - value <= CLUSTER * values[j]]
        if near:
            near = np.array(near)
            rest = z - near.T @ (near @ z)
            for _ in range(5):
                if np.linalg.norm(rest) > 0.5:
                    break
                z = solved(pivots, down, rng.normal(size=len(z)))
                rest = z - near.T @ (near @ z)
                rest = solved(pivots, down, rest / np.linalg.norm(rest))
                rest -= near.T @ (near @ rest)
            z = rest - near.T @ (near @ rest)
            z /= np.linalg.norm(z)
        made.append(z)
    return values, np.array(made).T


def singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of ``r``, falling, and the right singular vectors as columns, the largest entry of each positive."""
    d = len(r)
    largest = float(np.max(np.abs(r))) if d else 0.0
    if largest == 0:
        return np.zeros(d), np.eye(d)
    main, upper, v = bidiagonalise(r / largest)
    top = max(np.max(np.abs(main)), np.max(np.abs(upper), initial=0.0))
    main = np.where(np.abs(main) < EPS * EPS * top, EPS * EPS * top, main)
    cuts = [0, *[k + 1 for k in range(d - 1) if abs(upper[k]) <= EPS * EPS * top], d]
    values, vectors = np.zeros(d), np.zeros((d, d))
    for a, b in zip(cuts, cuts[1:], strict=False):
        values[a:b], vectors[a:b, a:b] = block_vectors(main[a:b], upper[a : b - 1])
    order = np.argsort(-values, kind="stable")
    vectors = v @ vectors[:, order]
    return values[order] * largest**2, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1, 1)
