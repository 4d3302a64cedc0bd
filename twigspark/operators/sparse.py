"""Sparse symmetric systems in a worker's memory: elimination in order of least degree, shift-and-invert for the smallest eigenvectors, and conjugate gradients.

Skeletons are nearly lines: eliminated from their ends and chains inwards they fill in little, so factors of 200,000 pixels stay at some numbers a pixel. What is left once every node has
many neighbours is factored as one dense block.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Neighbours from which on the rest of a graph is taken for dense, and nodes that such a rest may have.
DENSE, CORE = 64, 8192


class Factor:
    """A symmetric positive definite matrix, given by its diagonal and entries (i, j, value) with i < j, ready to solve with."""

    def __init__(self, diagonal: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray):
        d = diagonal.astype(float).tolist()
        near: list[dict[int, float]] = [{} for _ in d]
        for a, b, v in zip(i.tolist(), j.tolist(), value.tolist(), strict=True):
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + v
        heap = [(len(x), k) for k, x in enumerate(near)]
        heapq.heapify(heap)
        left = np.ones(len(d), bool)
        self.steps: list[tuple[int, float, np.ndarray, np.ndarray]] = []
        while heap:
            degree, p = heapq.heappop(heap)
            if not left[p] or degree != len(near[p]):
                continue
            if degree > DENSE:
                break
            left[p] = False
            own = list(near[p].items())
            for x, (a, v) in enumerate(own):
                row, part = near[a], v / d[p]
                del row[p]
                d[a] -= v * part
                for b, u in own[:x]:
                    row[b] = near[b][a] = row.get(b, 0.0) - part * u
            for a, _ in own:
                heapq.heappush(heap, (len(near[a]), a))
            self.steps.append((p, d[p], np.array([a for a, _ in own], "i8"), np.array([v / d[p] for _, v in own])))
            near[p] = {}
        self.core = np.flatnonzero(left)
        if len(self.core) > CORE:
            raise ValueError(f"{len(self.core)} nodes with more than {DENSE} neighbours each are left: this graph is no skeleton")
        dense = np.zeros((len(self.core),) * 2)
        at = {int(c): k for k, c in enumerate(self.core)}
        for c, k in at.items():
            dense[k, k] = d[c]
            for b, v in near[c].items():
                dense[k, at[b]] = v
        self.lower = np.linalg.cholesky(dense) if len(self.core) else dense

    def solve(self, right: np.ndarray) -> np.ndarray:
        y = right.astype(float)
        for p, _, near, part in self.steps:
            y[near] -= part[:, None] * y[p]
        if len(self.core):
            y[self.core] = np.linalg.solve(self.lower.T, np.linalg.solve(self.lower, y[self.core]))
        for p, pivot, near, part in reversed(self.steps):
            y[p] = y[p] / pivot - part @ y[near]
        return y


def times(i: np.ndarray, j: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The product of a symmetric matrix without diagonal, given by entries with i < j, and the columns of x."""
    out = np.zeros_like(x)
    for c in range(x.shape[1]):
        out[:, c] = np.bincount(i, value * x[j, c], len(x)) + np.bincount(j, value * x[i, c], len(x))
    return out


def smallest(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, count: int, tolerance: float = 1e-6, rounds: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, residual norms) of the count smallest of the normalised Laplacian of a graph with edges (i, j, w), i < j.

    Block Krylov spaces of the inverse of the matrix, shifted by a hair, restarted from their best vectors until every residual is below tolerance times the largest eigenvalue asked for (which decides in
    graphs whose eigenvalues are tiny, such as long lines). A residual that isn't met after so many rounds is given as it is."""
    degree = np.bincount(i, w, n) + np.bincount(j, w, n)
    root = 1 / np.sqrt(np.maximum(degree, 1e-300))
    value = -w * root[i] * root[j]
    diagonal = (degree > 0).astype(float)
    apply = lambda x: diagonal[:, None] * x + times(i, j, value, x)
    count = min(count, n)
    block = min(n, count + 4)
    if n <= 4 * block:
        dense = np.diag(diagonal)
        np.add.at(dense, (i, j), value)
        np.add.at(dense, (j, i), value)
        values, vectors = np.linalg.eigh(dense)
    else:
        inverse = Factor(diagonal + 1e-9, i, j, value)
        vectors = np.random.default_rng(seed).normal(size=(n, block))
        for _ in range(rounds):
            basis = np.linalg.qr(vectors)[0]
            last = basis
            for _ in range(2):
                last = inverse.solve(last)
                for _ in range(2):  # twice, against the loss of digits
                    last -= basis @ (basis.T @ last)
                last = np.linalg.qr(last)[0]
                basis = np.hstack([basis, last])
            basis = np.linalg.qr(basis)[0]
            values, small = np.linalg.eigh(basis.T @ apply(basis))
            vectors = basis @ small[:, :block]
            off = np.linalg.norm(apply(vectors[:, :count]) - vectors[:, :count] * values[:count], axis=0)
            if off.max() <= tolerance * max(values[count - 1], 1e-9):
                break
    values, vectors = values[:count], vectors[:, :count]
    return values, vectors, np.linalg.norm(apply(vectors) - vectors * values, axis=0)


def conjugate(apply, diagonal: np.ndarray, right: np.ndarray, tolerance: float = 1e-12, rounds: int = 10_000) -> tuple[np.ndarray, float]:
    """(solution, largest residual as a part of its right side) of apply(x) = right for a symmetric positive definite operator, column by column at once, scaled by the diagonal."""
    x = np.zeros_like(right)
    r = right.copy()
    scale = 1 / np.maximum(diagonal, 1e-300)[:, None]
    z = scale * r
    p, rz = z.copy(), (r * z).sum(axis=0)
    size = np.maximum(np.linalg.norm(right, axis=0), 1e-300)
    for _ in range(rounds):
        if (np.linalg.norm(r, axis=0) <= tolerance * size).all():
            break
        q = apply(p)
        step = rz / np.maximum((p * q).sum(axis=0), 1e-300)
        x += step * p
        r -= step * q
        z = scale * r
        new = (r * z).sum(axis=0)
        p = z + (new / np.maximum(rz, 1e-300)) * p
        rz = new
    return x, float((np.linalg.norm(apply(x) - right, axis=0) / size).max(initial=0))
