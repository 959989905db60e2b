"""The largest eigenpairs of a symmetric matrix by FEAST: contour integration, Rayleigh-Ritz, inertia counts.

A circle through two points of the real line encloses the eigenvalues between them.  The integral of (zI - V)^-1 along it
projects onto their eigenvectors; a Gauss-Legendre rule needs one complex shifted solve per node of the upper half, for
the lower half is its conjugate.  Rayleigh-Ritz on the projected block gives eigenpairs, and the block of these is
projected again until they stand still.  How many eigenvalues an interval holds is known beforehand and exactly, from the
inertia of V - sI, so a missed one is seen.
"""

from __future__ import annotations

import numpy as np

NODES = 16
ROUNDS = 60
#: Eigenvalues of a matrix of entries up to 1 that are closer than this are not told apart.
TIGHT = 1e-13


def tridiagonal(v: np.ndarray) -> tuple[list[float], list[float]]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the eigenvalues of `v` (Householder reflections)."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        norm = x @ x
        if norm:
            rest = a[k + 1 :, k:]
            rest -= np.outer(x, 2 / norm * (x @ rest))
            rest = a[k:, k + 1 :]
            rest -= np.outer(rest @ x, 2 / norm * x)
    return np.diag(a).tolist(), (np.diag(a, -1) ** 2).tolist()


def above(t: tuple[list[float], list[float]], shift: float) -> int:
    """How many eigenvalues exceed `shift`: by Sylvester's law the positive pivots of LDL' of the shifted matrix."""
    count, pivot, tiny = 0, 1.0, np.finfo(float).tiny
    for x, y in zip(t[0], [0.0, *t[1]]):
        pivot = x - shift - y / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def project(v: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block's part in the eigenvectors with eigenvalues from low to high, nearly."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for x, w in zip(nodes, weights):
        turn = np.exp(1j * np.pi / 2 * (x + 1))
        out += w / 2 * radius * np.real(turn * np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, block.astype(complex)))
    return out


def in_interval(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs from low to high, largest first."""
    n, scale = len(v), np.abs(v).sum(axis=1).max()
    width = min(n, 2 * count + 8)
    block = np.linalg.qr(np.random.default_rng(1).standard_normal((n, width)))[0]
    before = np.inf
    for _ in range(ROUNDS):
        q = np.linalg.qr(project(v, block, low, high))[0]
        values, turn = np.linalg.eigh(q.T @ v @ q)
        block = q @ turn
        inside = np.flatnonzero((values > low) & (values <= high))
        left = np.abs(v @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0.0)
        # at the limit of double precision the residual no longer falls
        if len(inside) == count and left <= 1e-12 * scale and left >= before / 2:
            return values[inside][::-1], block[:, inside][:, ::-1]
        before = left if len(inside) == count else np.inf
    raise ArithmeticError(f"found {len(inside)} of {count} eigenvalues in ({low}, {high}], residual {left}")


def largest(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Bisection by inertia finds an interval with k eigenvalues at least, and with more only if some are closer to the k-th
    than double precision tells.  Equal eigenvalues give some orthonormal basis of their space.
    """
    n, size = len(v), np.abs(v).max(initial=0.0)
    k = min(k, n)
    if not size or not k:
        return np.zeros(k), np.eye(n)[:, :k]
    v = v / size
    t = tridiagonal(v)
    top = float(np.abs(v).sum(axis=1).max()) + 1e-3  # no eigenvalue lies beyond
    low, high, found = -top, top, n
    # low has `found` >= k eigenvalues above it, high fewer than k
    while found > k and high - low > TIGHT:
        middle = (low + high) / 2
        c = above(t, middle)
        if c >= k:
            low, found = middle, c
        else:
            high = middle
    if found < n:
        # the filter parts best in the middle of the gap
        low = (bound(t, found, low, top) + bound(t, found + 1, -top, low)) / 2
    values, vectors = in_interval(v, low, top, found)
    return values[:k] * size, vectors[:, :k]


def bound(t, count: int, low: float, high: float) -> float:
    """The count-th largest eigenvalue, which lies between low and high."""
    while high - low > TIGHT / 4:
        middle = (low + high) / 2
        low, high = (middle, high) if above(t, middle) >= count else (low, middle)
    return (low + high) / 2
