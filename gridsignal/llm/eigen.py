"""Eigenvectors of a symmetric matrix by mixed-precision refinement.

A solver in single precision gives the start. Each round then corrects all vectors at once by products in double precision
(Ogita and Aishima): from how far they are from being orthonormal and from making the matrix diagonal follow, pair by pair,
the parts that they have of each other. Pairs of eigenvalues that are too close to tell apart cannot be corrected that way;
the vectors of each such cluster are rotated by the eigenvectors of the matrix restricted to them, shifted by the middle of
the cluster, so that the differences of its eigenvalues are not lost beside their size.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 12
CLOSE = 1e-7  # eigenvalues this close, relative to the largest, are told apart by sub-solves only


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Numbers of eigenvalues that lie within ``gap`` of the next one, two and more to a cluster."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def distances(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far the columns are from being orthonormal, their products with the matrix, and their eigenvalues."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    return (r + r.T) / 2, (s + s.T) / 2, np.diag(s) / (1 - np.diag(r))


def eigenvectors(matrix: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    d = len(matrix)
    size = np.abs(matrix).max(initial=0.0)
    if not size > 0:
        return np.zeros(d), np.eye(d)
    a = (matrix + matrix.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    spread = np.linalg.norm(a, 2)
    best, kept = np.inf, x
    for _ in range(rounds):
        r, s, values = distances(a, x)
        off = np.linalg.norm(s - np.diag(values), 2) / spread + np.linalg.norm(r, 2)
        if off < best:
            best, kept = off, x
        if off < d * np.finfo(np.float64).eps:
            break
        gap = max(2 * off, CLOSE) * spread
        near = clusters(values, gap)
        if near:
            x = x.copy()
            for c in near:
                q = np.linalg.qr(x[:, c])[0]
                inner = q.T @ (a @ q - values[c].mean() * q)
                x[:, c] = q @ np.linalg.eigh((inner + inner.T) / 2)[1]
            r, s, values = distances(a, x)
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > gap
        # a turn, which is skew and keeps lengths and angles, and half of what they are off
        turn = np.where(far, (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(far, apart, 1.0), 0.0)
        x = x + x @ (turn + r / 2)
    values = np.einsum("ij,ij->j", kept, a @ kept) / np.einsum("ij,ij->j", kept, kept)
    order = np.argsort(-values, kind="stable")
    values, kept = values[order] * size, kept[:, order]
    kept = kept / np.linalg.norm(kept, axis=0)
    return values, kept * np.sign(kept[np.abs(kept).argmax(axis=0), np.arange(d)])
